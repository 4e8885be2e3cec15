"""The analyses: each function takes DataFrames and returns DataFrames."""
