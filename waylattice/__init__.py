"""waylattice: a Spark-native engine for localisation, mapping and run-log analytics."""

__version__ = "0.1.0"
