"""annolyte: a PySpark-native engine for annotation-quality and corpus analytics."""
