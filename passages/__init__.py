"""Passage retrieval on Spark: chunk, embed, store, search, splice, rerank, prompt."""
