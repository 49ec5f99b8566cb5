"""Data-quality, reconciliation and acceptance-ledger analytics on Spark DataFrames."""
