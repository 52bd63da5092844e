"""Spark-native property-graph analytics for source code and for relational graph views."""

__version__ = "0.1.0"
