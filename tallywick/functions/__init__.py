"""Column expressions: fixed-point numbers and text timestamps."""
