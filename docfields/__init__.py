"""docfields: field extraction from scanned business documents, as Spark plans."""
