"""termloom: search-query analytics on Spark DataFrames."""
