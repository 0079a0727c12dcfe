"""Operators over DataFrames: evaluation, statistics, series, matrices, calculus, equations, geometry."""
