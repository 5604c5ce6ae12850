"""Operators on tables of a catalog and on their contents."""
