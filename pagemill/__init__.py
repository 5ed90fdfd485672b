"""Document analytics expressed as Spark plans."""
