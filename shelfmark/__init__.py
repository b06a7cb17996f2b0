"""Shelfmark: catalog intelligence as PySpark DataFrame transformations."""
