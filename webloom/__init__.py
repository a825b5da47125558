"""Web-content analytics as Spark DataFrame operators."""
