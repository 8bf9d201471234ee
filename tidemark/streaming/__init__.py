"""Streaming forms of the snapshot, bar, alert and order flows."""
