"""Tender evaluation over all jobs at once, as Spark DataFrame jobs."""
