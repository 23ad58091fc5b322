"""Relational and search operators."""
