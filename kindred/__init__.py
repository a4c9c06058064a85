"""A record-linkage engine on Spark: DataFrames in, DataFrames out."""
