"""Tidemark: document retrieval, collection upkeep and training-data preparation as Spark DataFrame plans."""
