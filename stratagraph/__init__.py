"""Stratagraph: versioned property-graph analytics on PySpark."""
