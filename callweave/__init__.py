"""callweave: a PySpark-native engine for code-dependency analytics and corpus preparation."""

__version__ = "0.1.0"
