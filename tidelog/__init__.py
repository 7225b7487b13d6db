"""A PySpark engine for event logs and the replicated state they describe."""
