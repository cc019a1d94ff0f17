"""A Spark-native engine for code-property-graph analytics."""

__version__ = "0.1.0"
