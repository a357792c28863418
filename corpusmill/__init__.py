"""corpusmill: corpus curation and analytics as Spark DataFrame plans."""
