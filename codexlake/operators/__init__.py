"""operators of codexlake."""
