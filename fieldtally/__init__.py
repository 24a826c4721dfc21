"""Species-occurrence analytics as plain PySpark DataFrame operators."""
