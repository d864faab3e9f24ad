"""quillstone: full-text search and search analytics expressed as ordinary Spark plans."""
