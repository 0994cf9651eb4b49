"""A PySpark-native engine for search, graph and text analytics over large corpora."""
