"""Causal time-series signals as Spark DataFrame jobs."""
