"""Column expressions: no shuffle, no Python UDF."""
