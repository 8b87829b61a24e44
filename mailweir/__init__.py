"""Spark-native processing of message streams, with a corpus-preparation subpackage."""
