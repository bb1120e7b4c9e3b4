"""Point-cloud analytics on Spark: clouds are DataFrames of points."""
