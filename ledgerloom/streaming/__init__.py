"""Aggregates kept up to date while transactions arrive."""
