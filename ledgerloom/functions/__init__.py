"""Scalar functions, each from columns to a column."""
