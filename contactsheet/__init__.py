"""Media-catalog analytics on Spark: DataFrame in, DataFrame out."""
