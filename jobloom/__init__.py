"""A PySpark engine for job-market data."""
