"""Operators of the library, all expressed on DataFrames."""
