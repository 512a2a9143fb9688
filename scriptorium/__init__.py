"""Scriptorium: a Spark-native engine for dual-tokenised historical text."""
