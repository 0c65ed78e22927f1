"""plumbline: streaming."""
