"""Operators: functions from DataFrames to DataFrames over all cities, datasets and tiles at once."""
