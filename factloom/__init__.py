"""factloom: a PySpark-native engine for evidence-grounded knowledge data."""

__version__ = "0.1.0"
