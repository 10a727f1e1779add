"""Strandline: a Spark-native engine for evidence-linked document graphs."""
