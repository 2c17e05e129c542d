"""Training-data operators: dedup, privacy, sharding, search, packing, mixing, scoring, repair, runs.

Nothing else in the library imports this subpackage.
"""
