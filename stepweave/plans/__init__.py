"""stepweave plans."""
