"""Training-data pipeline operators: sharding, mixing, quality rules, near-dedup,
token counts, fingerprints, packing, secret scans, LM scoring and line dedup.

Nothing else in the library imports this subpackage.
"""
