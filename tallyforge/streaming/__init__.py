"""Structured Streaming twins of batch tables; an extension."""
