"""corvane: Spark-first analytics operators over Parquet tables."""
