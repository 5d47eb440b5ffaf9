"""Vector collections with typed metadata on Spark DataFrames."""
