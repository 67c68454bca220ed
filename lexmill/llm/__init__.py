"""Training-data operators: sharding, dedup, scoring, mixing, tokenization and media columns.

Nothing outside this subpackage (and the pipeline at the repository top) imports it.
"""
