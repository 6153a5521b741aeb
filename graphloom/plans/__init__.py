"""Whole algorithms built from operators, and the registered queries."""
