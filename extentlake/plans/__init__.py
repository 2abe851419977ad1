"""Workload projections and the query catalogue."""
