"""bibspark: a PySpark-native engine for bibliographic records."""

__version__ = "0.1.0"
