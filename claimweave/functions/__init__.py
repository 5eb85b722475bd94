"""Claim-graph analytics on Spark."""
