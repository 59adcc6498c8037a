"""stepforge: episode data processing on Spark DataFrames."""
