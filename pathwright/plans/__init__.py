"""Registered queries beyond the catalogue's core."""
