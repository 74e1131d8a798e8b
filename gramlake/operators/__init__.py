"""Operators on point frames: (id, x array<double>) tables and plain columns."""
