"""Operators that prepare code and text for training; nothing else in the library imports this."""
