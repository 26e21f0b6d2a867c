"""Training-data operators: extraction, scans, filters, quality, dedup, mixing, packing, shards, search."""
