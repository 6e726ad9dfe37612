"""Token data and next-token statistics for source-code corpora on Spark."""
