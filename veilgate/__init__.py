"""Governed text, retrieval, feature and audit analytics as Spark DataFrame operators."""
