"""quillmesh.streaming"""
