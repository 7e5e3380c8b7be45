"""codeloom: a PySpark-native engine for source-code catalogues, reference graphs and their text."""

__version__ = "0.1.0"
