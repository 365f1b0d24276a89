"""Text and vector retrieval on Spark: scan, chunk, embed, store, search, refresh, evaluate."""
