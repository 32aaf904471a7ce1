"""Operators for preparing training data for language models, and their queries."""
