"""Operators of the collection types: relations in, relations out, no jobs of their own."""
