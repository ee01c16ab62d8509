"""Geospatial analytics on Spark DataFrames: grids, vector features and point clouds."""
