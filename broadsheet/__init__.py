"""A Spark-native engine for text archives: ingest, clean, annotate, query, analyse."""
