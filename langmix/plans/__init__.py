"""Bindings of the operators to the driver tables and their oracle SQL."""
