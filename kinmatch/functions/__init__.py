"""Column functions: names, cell normalisation, display text, identifiers and text vectors."""
