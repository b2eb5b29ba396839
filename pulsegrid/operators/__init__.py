"""Operators over records, sessions and daily metrics, as DataFrame transformations."""
