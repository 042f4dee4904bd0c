"""Programs as logical plans."""
