"""Structured Streaming form of the preparation step over arriving daily dumps."""
