"""Rule files: readers for three spellings, one syntax tree, and its checks."""
