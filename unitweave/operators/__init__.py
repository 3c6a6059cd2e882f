"""Distributed operators over text tables and pair data."""
