"""Operators on texts and training data. Nothing outside this subpackage imports it."""
