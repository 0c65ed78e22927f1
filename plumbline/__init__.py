"""plumbline: a PySpark-native engine for change, coverage, test-event and experiment data."""
