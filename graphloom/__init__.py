"""graphloom: source-code graphs as Spark DataFrames."""
