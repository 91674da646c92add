"""Structured Streaming forms of the time-series and policy operators."""
