"""Lexiloom: a Spark-native engine for typed, normalised entity annotation of text collections."""
