"""Siltstone plans."""
