"""docfields.plans."""
