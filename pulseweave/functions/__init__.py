"""Column expressions: time arithmetic, clinical scalars, sample arrays."""
