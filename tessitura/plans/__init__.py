"""Layouts, domain views and whole pipelines."""
