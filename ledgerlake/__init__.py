"""Filing analytics on Spark: DataFrame-to-DataFrame operators over many filings at once."""
