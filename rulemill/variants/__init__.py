"""Genomic variants: the 36-attribute schema, XML extraction and derived attributes."""
