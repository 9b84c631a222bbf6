"""The pipeline over streams of documents."""
