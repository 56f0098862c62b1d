"""Place-and-time risk tables on Spark: DataFrame in, DataFrame out."""
