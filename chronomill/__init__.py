"""chronomill: a PySpark-native engine for evidence-scoped, bitemporal knowledge records."""

__version__ = "0.1.0"
