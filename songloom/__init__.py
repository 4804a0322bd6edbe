"""songloom: text retrieval and ranking over a large song corpus, on Spark DataFrames."""
