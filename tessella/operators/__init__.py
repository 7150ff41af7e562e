"""Operators: functions from DataFrames to DataFrames. Time-dependent ones take the instant `as_of`."""
