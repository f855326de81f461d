"""Readers, sinks and adapters for the match tables."""
