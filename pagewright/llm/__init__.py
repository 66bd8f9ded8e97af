"""Operators on texts of large training corpora. Nothing else in the library imports this package."""
