"""Whole queries: a check from files to report, and the command line."""
