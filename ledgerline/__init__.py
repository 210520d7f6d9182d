"""Ledgerline: record reconciliation and analytics on Spark DataFrames."""
