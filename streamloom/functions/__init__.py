"""Types and schema functions."""
