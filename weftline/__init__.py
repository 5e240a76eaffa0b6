"""weftline: a Spark-native engine for corpus preparation and experiment analytics."""

__version__ = "0.1.0"
