"""Operators for building text training sets: each module is one operator."""
