"""A Spark-native engine for memories, semantic search and corpus preparation."""
