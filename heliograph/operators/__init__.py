"""Queries over span, log and metric tables."""
