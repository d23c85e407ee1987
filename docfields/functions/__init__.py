"""docfields.functions."""
