"""Column functions: each takes and returns columns and stays inside Spark's code generation."""
