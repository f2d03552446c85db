"""Training-data operators on documents, web pages and embeddings."""
