"""Quayside: a PySpark-native engine for event listings."""
