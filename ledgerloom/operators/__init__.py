"""Operators on columns and data frames."""
