"""Column expressions: scalars, privacy, wire formats, time windows."""
