"""latticework: multi-dimensional array analytics on Spark DataFrames."""
