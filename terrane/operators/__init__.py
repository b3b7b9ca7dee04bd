"""Cleaning, encoding, splitting, metrics, statistics and models over DataFrames."""
