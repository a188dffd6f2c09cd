"""Column functions: plain expressions, no Python on executors unless stated."""
