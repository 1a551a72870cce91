"""Place-based analytics on Spark DataFrames."""
