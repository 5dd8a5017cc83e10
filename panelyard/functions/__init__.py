"""Column expressions: pure functions of columns, all JVM-side."""
