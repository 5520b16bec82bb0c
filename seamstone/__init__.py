"""seamstone: a PySpark-native engine for analysing document and source-code collections."""
