"""stepweave sources."""
