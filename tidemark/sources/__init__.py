"""Readers: landed files and the views that stand in for them over the sample tables."""
