"""Readers of documents and dictionaries."""
