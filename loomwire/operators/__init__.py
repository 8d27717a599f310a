"""Operators of loomwire."""
