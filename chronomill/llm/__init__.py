"""Operators on texts for training data: record twins, code and documentation, encoding, leaks, splitting."""
