"""Evidence analytics on Spark DataFrames."""
