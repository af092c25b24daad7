"""muster: whole-table training-records operators on the Spark DataFrame API.

Sub-packages
------------
sources    table scans, strict NDJSON ingest, JSON sinks, snapshots
functions  column-expression helpers (ids, text tokens, predicates, hashing)
operators  listings, validation, constraint audits, lookups, access, mutations,
           batch rate limiting
plans      listing specs, stand-in tables derived from the driver data, query catalog
streaming  Structured Streaming token bucket
"""

__version__ = "0.1.0"
