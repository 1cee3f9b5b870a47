"""Listing discovery on Spark: normalise, filter, merge, expire, score and read listings."""
