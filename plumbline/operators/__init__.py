"""plumbline: operators."""
