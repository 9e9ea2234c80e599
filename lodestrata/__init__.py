"""A Spark-native engine for knowledge corpora: sources, chunks, collections, retrieval, quality gates and monitoring."""
