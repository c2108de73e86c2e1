"""Column expressions: calendar parts, text helpers and error metrics."""
