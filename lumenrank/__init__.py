"""lumenrank: retrieval, ranking and data preparation over Spark DataFrames."""
