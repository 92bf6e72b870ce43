"""Byte-plane analytics on Spark."""
