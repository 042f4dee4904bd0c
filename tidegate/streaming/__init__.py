"""Programs over live streams."""
