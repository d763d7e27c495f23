"""The live runtime."""
