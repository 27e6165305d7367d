"""Declared schemas, scans and sinks."""
