"""docflow: a PySpark-native engine for multilingual document processing."""

__version__ = "0.1.0"
