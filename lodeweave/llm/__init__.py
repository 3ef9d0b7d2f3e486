"""Operators for training data made of texts and vectors."""
