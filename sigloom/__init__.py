"""Spark-native analytics over labelled signal collections and model scores."""

__version__ = "0.1.0"
