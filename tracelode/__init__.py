"""Trace analytics on PySpark."""
