"""Catalog tools: validation, linting, comparison, cost, charts, search, documentation."""
