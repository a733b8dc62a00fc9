"""Streams of events as traces."""
