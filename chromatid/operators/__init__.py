"""Operators: functions of DataFrames to DataFrames, lazy but for the loops' tests of their ends."""
