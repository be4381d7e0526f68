"""Design-consistency analytics as Spark DataFrame operators."""
