"""Tessera: timeline, rule and matching analytics on PySpark."""
