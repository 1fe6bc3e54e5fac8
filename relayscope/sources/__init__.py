"""Readers: stored tables, raw messages, small dimensions."""
