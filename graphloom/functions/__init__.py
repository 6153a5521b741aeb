"""Column and Python helpers used by operators."""
