"""Readers for alignments, annotations and null-distribution tables."""
