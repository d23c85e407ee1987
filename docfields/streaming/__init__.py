"""Extraction of documents as they arrive."""
