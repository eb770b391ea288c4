"""Customer-feedback text analytics as PySpark DataFrame operators."""
