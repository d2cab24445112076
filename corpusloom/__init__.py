"""A document-corpus and retrieval engine on Spark DataFrames."""
