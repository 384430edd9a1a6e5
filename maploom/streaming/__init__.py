"""Streams of arriving observations. The map operators themselves are all batch."""
