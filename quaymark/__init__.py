"""Quaymark: a Spark-native engine for interval price bars and corpus preparation."""
