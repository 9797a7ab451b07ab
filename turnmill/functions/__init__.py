"""Column functions: text, tokens, distributions."""
