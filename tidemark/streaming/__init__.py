"""Structured Streaming drain of impressions with idempotent sinks."""
