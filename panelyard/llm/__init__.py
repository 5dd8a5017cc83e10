"""Operators that prepare text collections for training; nothing else in the library depends on them."""
