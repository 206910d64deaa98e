"""Detection-data curation and evaluation as Spark DataFrame operations."""
