"""Structured Streaming jobs over the crawl event log."""
