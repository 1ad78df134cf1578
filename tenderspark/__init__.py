"""Opportunity-matching analytics as Spark DataFrame jobs."""
