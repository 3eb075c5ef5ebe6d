"""timelens: analytics over interval-shaped activity records, on Spark DataFrames."""
