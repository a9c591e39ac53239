"""Operators on training text: encoding, mixing and look-alike text.  Nothing outside this folder imports it."""
