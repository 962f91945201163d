"""Portfolio performance and sector attribution on Spark DataFrames."""
