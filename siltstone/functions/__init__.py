"""Column expressions and driver-side helper functions."""
