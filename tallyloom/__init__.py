"""Session-cost analytics on Spark DataFrames."""
