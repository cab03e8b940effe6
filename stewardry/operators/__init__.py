"""Operators: DataFrame(s) in, lazy DataFrame out."""
