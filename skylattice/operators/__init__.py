"""Joins, aggregations and set operations over catalogues, cells and coverage tables."""
