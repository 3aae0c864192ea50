"""Spark-native analytics over procedural documents, tool-use conversations and execution traces."""
