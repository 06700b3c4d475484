"""gridloom: dense arrays and images as Spark DataFrames."""
