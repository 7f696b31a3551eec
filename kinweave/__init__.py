"""Kinweave: profile linkage and analytics as lazy PySpark plans."""
