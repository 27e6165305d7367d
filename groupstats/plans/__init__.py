"""Staged runs, end-to-end recipes and the query catalogue over the test tables."""
