"""Fitted stages applied to streams."""
