"""Operators for training data: grouping, matching, de-duplication, text. Nothing else in the library imports them."""
