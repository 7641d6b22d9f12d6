"""Training-data operators: ten corpus components built on Spark DataFrames."""
