"""RAG-corpus health analytics on Spark DataFrames."""
