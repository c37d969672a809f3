"""blocklens: block, byte and archive analytics as Spark DataFrame plans."""
