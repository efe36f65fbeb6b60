"""Retrieval-dataset engine on PySpark: build, clean, split and evaluate text-retrieval training data."""
