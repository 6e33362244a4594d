"""Content ingest and digest operators on Spark DataFrames."""
