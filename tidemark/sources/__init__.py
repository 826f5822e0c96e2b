"""Readers of news, prices, runs, feeds and pages; writers of results."""
