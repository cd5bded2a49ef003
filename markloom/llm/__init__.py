"""Operators for large training-text collections.  Nothing else in the package imports this folder."""
