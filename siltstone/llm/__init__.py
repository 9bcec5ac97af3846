"""Operators for training data: statistics, leakage, tokenizers, sentences."""
