"""Helpers on values: units and vocabularies."""
