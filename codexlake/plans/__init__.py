"""plans of codexlake."""
