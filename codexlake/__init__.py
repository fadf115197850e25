"""codexlake: catalogue, document and corpus analytics as PySpark DataFrame plans."""
