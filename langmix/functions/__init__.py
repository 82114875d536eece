"""Column functions: text rules, label formats, array math (no Python UDFs)."""
