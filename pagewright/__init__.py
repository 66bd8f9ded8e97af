"""pagewright: a PySpark-native engine for document-processing analytics."""

__version__ = "0.1.0"
