"""Streams over the events table."""
