"""Event collection and log analytics on Spark DataFrames."""
