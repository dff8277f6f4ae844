"""Spark-native spatio-temporal activity analytics."""

from . import more, queries  # noqa: F401  both register their queries
