"""Training-data operators: dedup, quality, toxicity, packing, mixing, WARC, URL rules.

Nothing outside this subpackage imports it.
"""
