"""streaming of codexlake."""
