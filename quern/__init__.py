"""quern: analytics and training-data operators written for Spark DataFrames and SQL."""
