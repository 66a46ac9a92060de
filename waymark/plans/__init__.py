"""Whole plans: index building, statistics, the query catalogue."""
