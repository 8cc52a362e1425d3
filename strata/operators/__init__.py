"""Operators on the data models: key-value pairs, documents, vectors and graphs."""
