"""A PySpark engine for media-analysis records."""
