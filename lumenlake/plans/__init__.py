"""Registered queries and their SQL, by theme."""
