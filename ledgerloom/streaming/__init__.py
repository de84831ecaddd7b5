"""Streams of invoices, corrections and audit events."""
