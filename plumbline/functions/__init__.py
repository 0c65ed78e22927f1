"""plumbline: functions."""
