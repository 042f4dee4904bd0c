"""Signal conditioning over message tables and streams, as ordinary Spark plans."""
