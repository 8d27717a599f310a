"""Sources of loomwire."""
