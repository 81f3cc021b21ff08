"""Comparison of two keyed datasets on Spark."""
