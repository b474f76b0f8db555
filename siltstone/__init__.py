"""Siltstone: corpus construction and evaluation analytics as Spark DataFrame plans."""
