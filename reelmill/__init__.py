"""Media-library planning and corpus preparation on Spark DataFrames."""
