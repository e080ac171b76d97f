"""Queries, their SQL, reports and whole runs."""
