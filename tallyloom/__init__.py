"""Review analytics and text-data operators on Spark DataFrames."""
