"""rostire: a Spark-native text annotation and corpus analytics engine."""

__version__ = "0.1.0"
