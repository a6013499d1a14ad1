"""Spark-native similarity analytics over nucleotide sketches and large record tables."""

__version__ = "0.1.0"
