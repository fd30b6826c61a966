"""Derived graphs, registered queries and their SQL."""
