"""Sequencing-read quality analytics as declarative DataFrame aggregations."""
