"""rankspark: build, fuse and judge candidate rankings with Spark DataFrames."""
