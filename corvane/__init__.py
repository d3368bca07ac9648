"""A PySpark-native engine for curating code-documentation corpora."""
