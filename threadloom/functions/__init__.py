"""Column functions: text, tokens, vectors, messages, validators."""
