"""Analytic plans over the stored tables, and the refresh that fills them."""
