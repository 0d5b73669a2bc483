"""Training-data operators: scoring, scanning, near-duplicate search, mixing and packing of text corpora on Spark."""
