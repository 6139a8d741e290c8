"""Knowledge-graph indexing and retrieval over Spark DataFrames."""
