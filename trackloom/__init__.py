"""Spark-native reconciliation of timestamped files with position tracks."""
