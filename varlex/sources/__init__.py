"""Scans of landed files and stored tables, and the sinks that write them."""
