"""Corpus operators for training-data work: filters, duplicates, mixing, sharding."""
