"""Structured Streaming forms of the crawl and document jobs."""
