"""Session and tool event analytics as PySpark DataFrame operators."""
