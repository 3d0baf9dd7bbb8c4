"""Structured Streaming over folders of documents."""
