"""Joins, aggregates, windows and graph operators."""
