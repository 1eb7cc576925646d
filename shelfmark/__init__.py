"""Shelfmark: catalog search and search evaluation as PySpark DataFrame plans."""
