"""docfields.sources."""
