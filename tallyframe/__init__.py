"""Reconciling tabular money statements against a ledger of record, on Spark."""
