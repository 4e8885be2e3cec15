"""Play-by-play football analytics on Spark DataFrames."""
