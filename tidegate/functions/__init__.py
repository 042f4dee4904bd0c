"""Values: numbers and texts, regular expressions, subjects, as Python and as Columns."""
