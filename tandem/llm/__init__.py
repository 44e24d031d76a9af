"""Operators of a training-data pipeline: filters, deduplication, sharding,
mixing, packing and scoring of documents. Nothing outside this package imports it."""
