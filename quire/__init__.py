"""Page-layout analytics on Spark: DataFrame-to-DataFrame operators."""
