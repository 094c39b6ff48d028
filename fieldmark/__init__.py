"""Repeated-visit survey analytics as lazy PySpark DataFrame functions."""

__version__ = "0.1.0"
