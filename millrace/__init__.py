"""millrace: retrieval, query-log and evaluation analytics as Spark DataFrame operators."""
