"""Scans and sinks that keep the order of records."""
