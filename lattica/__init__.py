"""Lattica: graph-orbit analytics and relational result tables on Spark DataFrames."""
