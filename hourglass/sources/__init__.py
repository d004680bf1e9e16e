"""Readers that shape landed files and feed payloads, and the sinks that publish results."""
