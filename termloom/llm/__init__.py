"""Operators for preparing text collections for language models."""
