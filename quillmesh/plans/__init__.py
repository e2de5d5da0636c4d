"""quillmesh.plans"""
