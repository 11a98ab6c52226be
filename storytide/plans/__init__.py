"""Logical inputs over the generic tables."""
