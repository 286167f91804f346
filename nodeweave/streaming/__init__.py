"""Streams of deliveries into the graph tables."""
