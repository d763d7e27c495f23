"""Sources, sinks and reference tables."""
