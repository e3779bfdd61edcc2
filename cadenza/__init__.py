"""Cadenza: a PySpark-native engine for speech-corpus curation and take evaluation."""
