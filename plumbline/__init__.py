"""Lakehouse analytics for manufacturing quality, written for PySpark."""
