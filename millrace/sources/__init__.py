"""Landed payloads of the job boards and the company registry."""
