"""Streams of re-crawled pages."""
