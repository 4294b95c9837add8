"""linkspan: deterministic entity resolution and record linkage on Spark DataFrames."""
