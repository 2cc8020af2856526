"""kithmark: a PySpark-native engine for linking and cleaning business records."""

__version__ = "0.1.0"
