"""corpusloom: text retrieval and corpus processing as Spark DataFrames."""
