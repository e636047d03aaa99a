"""Spark-native business analytics: commerce metrics, corpus preparation, hybrid
retrieval, question routing, run-log analytics, answer auditing and evaluation."""
