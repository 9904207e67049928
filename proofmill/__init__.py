"""proofmill: document-editing analytics and training-data preparation as Spark jobs."""
