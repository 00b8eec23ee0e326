"""Reconciliation, auditing and analytics of tabular evidence on Spark."""
