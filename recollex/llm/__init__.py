"""Operators for preparing language-model training data; `queries` registers them."""
