"""millrace: a Spark-first relational analytics engine with a compact SQL dialect."""
