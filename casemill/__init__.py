"""casemill: document-collection analytics expressed as PySpark DataFrame and SQL plans."""
