"""Operators over event frames."""
