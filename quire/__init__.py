"""Quire: a PySpark-native engine for analysing controlled documents."""
