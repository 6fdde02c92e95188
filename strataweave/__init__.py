"""strataweave: bi-temporal fact graphs, hybrid ranked retrieval and text-corpus preparation on Spark DataFrames."""
