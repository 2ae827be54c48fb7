"""Scans of media, records and logs, and their sinks."""
