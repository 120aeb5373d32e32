"""Readers and writers, and the stand-ins for video tables."""
