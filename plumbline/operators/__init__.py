"""Analyses as functions from DataFrames to DataFrames."""
