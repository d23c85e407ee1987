"""docfields.operators."""
