"""Stateless operators on file streams."""
