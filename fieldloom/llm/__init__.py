"""Training-data operators: text, embeddings and pages at corpus scale."""
