"""Ordered visual timelines on Spark: filtering, folding, scoring, clustering and selecting frames with DataFrames."""
