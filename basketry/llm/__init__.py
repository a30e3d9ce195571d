"""Operators that a training-data pipeline over text needs, as Spark jobs."""
