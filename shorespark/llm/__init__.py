"""Operators for large training corpora and learned search; nothing else in the package imports this."""
