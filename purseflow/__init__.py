"""Household-ledger analytics on Spark: evidence in, exact monthly money tables out."""
