"""Streaming form of the resumable append."""
