"""Spark-native operators for haplotype phasing, assembly intervals and sequence tables."""

__version__ = "0.1.0"
