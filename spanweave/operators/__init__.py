"""Operators on road graphs."""
