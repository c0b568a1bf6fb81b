"""A Spark-first engine for image-forensics evaluation runs."""
