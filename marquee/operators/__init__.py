"""Operators: functions from DataFrames to DataFrames, without a global session."""
