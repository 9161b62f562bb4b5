"""Training-data operators: search, near duplicates, extraction, mixing, scoring, packing, output.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and ``oracles`` their SQL.
"""
