"""Column functions: normalisation, tokens and similarities."""
