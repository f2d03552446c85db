"""Column functions: names, dates, geometry, vectors and small scalar rules."""
