"""CI failure analytics as Spark DataFrame operators."""
