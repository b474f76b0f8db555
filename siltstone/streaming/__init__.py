"""Siltstone streaming."""
