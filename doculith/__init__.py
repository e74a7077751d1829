"""Document structure analytics as Spark DataFrame operators."""
