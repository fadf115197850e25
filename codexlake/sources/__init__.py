"""sources of codexlake."""
