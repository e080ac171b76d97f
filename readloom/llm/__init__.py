"""Operators for large text collections; nothing else in the package imports this folder."""
