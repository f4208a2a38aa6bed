"""Operators for training data; nothing outside imports this subpackage."""
