"""Column expressions; none runs Python on executors."""
