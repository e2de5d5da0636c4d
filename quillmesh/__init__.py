"""quillmesh: note search, tagging and corpus preparation as Spark DataFrame plans."""
