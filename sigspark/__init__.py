"""Spark-native preparation, tokenisation and scoring of multi-lead biosignals and their text."""
