"""Point-in-time analytics on Spark: DataFrame-to-DataFrame operators for dated paired-contest data."""
