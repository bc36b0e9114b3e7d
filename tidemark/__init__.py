"""Analytics for question answering over timestamped streams, on Spark DataFrames."""
