"""Question-answering corpora and their request logs as batch and streaming Spark jobs."""
