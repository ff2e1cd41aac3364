"""tokenloom: text tables in, ordered token corpora out, on Spark DataFrames."""
