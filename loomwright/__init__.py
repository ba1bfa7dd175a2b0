"""Knowledge-corpus engine on Spark DataFrames."""
