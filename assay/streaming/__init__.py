"""Structured Streaming forms of the progress guard and of the wave fold."""
