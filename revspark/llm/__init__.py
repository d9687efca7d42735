"""Training-data operators: mixing, toxicity, sharding, page text, vector search,
near duplicates, exact top-k, packing, secret scans and quality scoring.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the folder is present.
"""
