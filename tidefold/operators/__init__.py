"""Operators on long DataFrames of bars, labels, splits and predictions."""
