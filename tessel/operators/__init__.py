"""Operators over plain DataFrames."""
