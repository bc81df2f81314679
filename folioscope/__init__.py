"""A document-text analytics engine on Spark DataFrames."""
