"""Column functions: text, similarity and answer scoring."""
