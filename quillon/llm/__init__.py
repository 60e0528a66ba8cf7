"""Operators for training-data pipelines: mixing, PII, packing, near-duplicate joins, toxicity, quality, chat formatting,
line deduplication, repeated-passage removal and exact vector search. Nothing outside this package imports it."""
