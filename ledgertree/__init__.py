"""Change-log and hierarchy analytics as PySpark DataFrame jobs."""
