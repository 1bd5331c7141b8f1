"""forktrack: single-molecule replication analytics on Spark DataFrames."""
