"""Factory-data analytics as Spark DataFrame operators."""
