"""Operators for preparing language-model training data, each in its own module; queries are in ``queries``."""
