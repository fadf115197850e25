"""functions of codexlake."""
