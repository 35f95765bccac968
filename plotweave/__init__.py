"""Spatial and statistical analytics over linked records, as functions from DataFrames to DataFrames."""
