"""Readers of landed payloads and text files, and the sinks."""
