"""Analytics for competition results, written on Spark DataFrames."""
