"""A PySpark-native engine for knowledge-graph, memory and evidence tables."""
