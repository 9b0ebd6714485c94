"""Operators for scenes that keep arriving."""
