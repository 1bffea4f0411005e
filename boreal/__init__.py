"""boreal: forest-risk analytics expressed as Spark DataFrames."""
