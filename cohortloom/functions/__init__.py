"""Column expressions: each takes and returns Spark columns and stays inside code generation."""
