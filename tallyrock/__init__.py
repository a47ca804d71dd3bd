"""Tallyrock: a Spark-first data-quality analytics engine for large listings tables."""
