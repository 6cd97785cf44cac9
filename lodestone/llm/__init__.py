"""Operators for large text and code collections."""
