"""Composed pipelines: the listing digest and the channel feed."""
