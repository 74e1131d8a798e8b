"""Immutable specifications and the registered queries."""
