"""Column-level helpers: casts, array helpers, stamps and derived attributes."""
