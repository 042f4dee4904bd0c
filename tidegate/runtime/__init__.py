"""Rules evaluated message by message: for streams, and for rules that no plan expresses."""
