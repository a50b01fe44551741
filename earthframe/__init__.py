"""Earth-observation analytics as PySpark DataFrame operators."""
