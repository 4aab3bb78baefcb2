"""Stored tables that change by whole versions."""
