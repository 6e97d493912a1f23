"""Waymark: a Spark-native engine for knowledge that has a place, a date and a text."""
