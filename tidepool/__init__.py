"""Spark-native triage of notes and records."""
