"""civicframe: a Spark-first analytics engine for public-accountability records."""
