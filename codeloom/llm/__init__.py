"""Operators that prepare code and text collections for training; nothing outside imports this."""
