"""Leakage-aware evaluation of time-series prediction on Spark."""

__version__ = "0.1.0"
