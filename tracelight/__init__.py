"""Spark operators for evidence, log and transcript tables."""
