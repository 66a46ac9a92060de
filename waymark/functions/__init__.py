"""Scalar expressions: text, geography, synonyms."""
