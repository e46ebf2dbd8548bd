"""Incremental variants for streams."""
