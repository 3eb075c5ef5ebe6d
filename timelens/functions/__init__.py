"""Column expressions: date parts, tag rules, labels."""
