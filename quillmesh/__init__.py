"""Spark-native retrieval, comparison and audit of versioned document collections."""
