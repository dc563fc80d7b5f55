"""Whole queries, built from tables to result."""
