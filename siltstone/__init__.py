"""Versioned key-value data and full-text search as DataFrame plans."""

__version__ = "0.1.0"
