"""Time-series, event and interval analytics as PySpark DataFrame operators."""
