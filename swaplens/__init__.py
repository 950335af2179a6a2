"""Paired-audit analytics as lazy PySpark DataFrame operators."""
