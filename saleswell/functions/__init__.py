"""Column expressions: pure ``Column -> Column`` helpers, all JVM-side."""
