"""Operators on event tables keyed by a series and a time."""
