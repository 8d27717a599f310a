"""Streaming of loomwire."""
