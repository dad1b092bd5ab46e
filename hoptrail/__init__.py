"""Path-measurement analytics as Spark DataFrame operators."""
