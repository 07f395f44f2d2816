"""Operators over DataFrames and over profiles."""
