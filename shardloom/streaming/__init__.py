"""Structured Streaming forms of the metric and status operators."""
