"""Composite reports and the query catalogue."""
