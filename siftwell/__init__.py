"""siftwell: text-corpus analytics and training-data operators on Spark DataFrames."""
