"""Spark-native triage of Java archives: relational operators over decoded archive tables."""
