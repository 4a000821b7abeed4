"""Column expressions: smoothing windows, multiplicity functions, cosmological scalars."""
