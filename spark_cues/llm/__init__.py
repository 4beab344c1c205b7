"""Training-data operators: search, chat parsing, deduplication, packing, scans, scoring, sharding."""
