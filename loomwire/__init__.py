"""loomwire: analytics over continuously collected text and events, on Spark."""
