"""stepweave streaming."""
