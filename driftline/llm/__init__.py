"""Training-data operators: ten Spark jobs over documents, pages and embeddings."""
