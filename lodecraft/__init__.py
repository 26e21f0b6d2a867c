"""lodecraft: corpus, answer, trace and training-data analytics on Spark DataFrames."""
