"""Waymark: a PySpark-native address search and geocoding engine."""
