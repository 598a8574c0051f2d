"""Operators for building text training data. Nothing else in the package imports this."""
