"""sievework: a Spark-first engine for document chunking, retrieval and corpus preparation."""
