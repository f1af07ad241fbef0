"""Column functions: cell cleaning, parsing, classification."""
