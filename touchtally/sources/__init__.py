"""Declared schemas, table readers and writers."""
