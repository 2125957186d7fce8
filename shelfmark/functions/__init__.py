"""Column functions: similarity of texts, flattening, text and URI expressions."""
