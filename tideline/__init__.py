"""Spark-native event-state engine (see README.md)."""
