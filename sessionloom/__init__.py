"""Session-corpus analytics expressed as Spark DataFrame pipelines."""
