"""stipple: point-set data processing on Spark DataFrames."""
