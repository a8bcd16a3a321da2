"""Timeline retrieval, evaluation and data-quality analytics on Spark DataFrames."""
