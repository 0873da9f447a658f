"""Registered queries over the test tables, and end-to-end protocols."""
