"""Productivity analytics and corpus preparation on DataFrames."""
