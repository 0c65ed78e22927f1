"""plumbline: plans."""
