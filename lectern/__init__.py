"""Document-perception analytics on Spark DataFrames."""
