"""Structured Streaming jobs; transformations shared with the batch side."""
