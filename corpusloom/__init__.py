"""corpusloom: code repositories and documents as Spark DataFrames, from files to retrieval context."""
