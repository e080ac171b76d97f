"""Alignment operators as DataFrame transformations."""
