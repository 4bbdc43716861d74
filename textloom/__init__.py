"""textloom: full-text search and text analytics expressed as Spark DataFrame plans."""
