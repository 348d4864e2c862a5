"""Change-impact and verification analytics over dependency graphs and run records."""
