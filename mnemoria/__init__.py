"""Long-term text memory on Spark: ingest, annotate, connect, believe, summarise, retrieve, fuse, evaluate."""
