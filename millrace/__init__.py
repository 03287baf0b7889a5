"""Posting and skill-demand analytics expressed as Spark jobs."""
