"""Column expressions and the distributed building blocks the operators share."""
