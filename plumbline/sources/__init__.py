"""plumbline: sources."""
