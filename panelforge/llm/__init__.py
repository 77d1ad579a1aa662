"""Training-data operators (dedup, search, language, mixing, privacy, packing, sharding).

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` registers the thin ``opN_*`` queries.
"""
