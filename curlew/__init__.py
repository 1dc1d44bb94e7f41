"""curlew: curation of instruction-tuning data on Spark DataFrames."""
