"""Operators over DataFrames; none reads the clock or the environment."""
