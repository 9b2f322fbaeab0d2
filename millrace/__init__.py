"""A corpus, retrieval and evaluation engine on Spark DataFrames."""
