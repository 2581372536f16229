"""Training-data operators (deduplication, scanning, packing, sharding, search).

Nothing outside this subpackage imports it.  The operators take and return
DataFrames; ``registry`` holds the thin queries that the driver runs.
"""
