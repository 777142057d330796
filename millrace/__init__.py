"""millrace: tabular data preparation, profiling and mining on Spark DataFrames."""
