"""Streams of arriving files through the batch transforms, and windowed aggregation of events."""
