"""Sources that Spark has no reader for: strict delimited text, office files, completion ledgers, coordination state."""
