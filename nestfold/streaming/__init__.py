"""Structured Streaming: feedback clicks, channel posts, instant pushes."""
