"""Document retrieval and back-office analytics as Spark plans."""
