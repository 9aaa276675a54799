"""A semantic query engine on Spark DataFrames."""
