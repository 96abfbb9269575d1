"""Substructure search over molecule collections, as DataFrame operations."""

__version__ = "0.1.0"
