"""Operators for preparing training text, separate from the rest of the library."""
