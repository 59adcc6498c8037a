"""Operators for texts and training data; nothing outside this folder imports it."""
