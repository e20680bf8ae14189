"""Report analytics on Spark: DataFrame-to-DataFrame operators for collections of published reports."""
