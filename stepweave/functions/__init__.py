"""stepweave functions."""
