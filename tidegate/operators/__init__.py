"""Forms as Columns and sorted folds."""
