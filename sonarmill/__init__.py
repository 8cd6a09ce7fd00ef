"""sonarmill: packet, container and signal analytics on Spark DataFrames."""
