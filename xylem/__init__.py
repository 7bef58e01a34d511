"""Xylem: a Spark-native engine for XML structure and path queries."""
