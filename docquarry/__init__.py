"""A PySpark-native engine for document collections: typed sources, retrieval, lookup, extraction and quality queries."""
