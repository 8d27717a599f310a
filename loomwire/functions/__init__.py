"""Functions of loomwire."""
