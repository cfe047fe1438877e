"""Road-network and record-cleaning analytics on Spark DataFrames."""
