"""Document retrieval and content analytics on Spark DataFrames."""
