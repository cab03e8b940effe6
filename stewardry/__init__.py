"""Checking, importing, reconciling and triaging large tables, logs and documents with Spark."""
