"""Entity x day measurement panels on Spark: every operator takes and returns DataFrames."""
