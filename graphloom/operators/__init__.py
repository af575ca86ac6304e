"""Operators on spatial graphs: functions from DataFrames to DataFrames."""
