"""Bound queries, reports and the stage registry."""
