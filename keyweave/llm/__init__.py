"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries.  Every operator takes and returns DataFrames and can be used alone.
"""
