"""Graph operators: each takes a Graph or DataFrames and returns a DataFrame."""
