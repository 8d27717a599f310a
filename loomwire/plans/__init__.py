"""Plans of loomwire."""
