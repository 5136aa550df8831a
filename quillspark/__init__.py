"""Market-data analytics and text-corpus operators on Spark DataFrames."""
