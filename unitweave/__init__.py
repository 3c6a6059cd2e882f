"""Spark-native long-text analytics: structure, sweeps, coverage, pairs, delivery."""
