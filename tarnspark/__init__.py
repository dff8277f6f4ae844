"""Spark-native spatio-temporal activity analytics."""
