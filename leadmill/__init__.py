"""Prospect mining on Spark: recall, enrichment, judging, ranking and reporting as DataFrame jobs."""
