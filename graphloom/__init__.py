"""A PySpark-native engine for knowledge-graph search and corpus preparation."""
