"""kelpline: a PySpark-native engine for code and document context retrieval and analytics."""
