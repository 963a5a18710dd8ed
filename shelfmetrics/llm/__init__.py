"""Training-data operators: scoring, extraction, filtering, joins, sharding, packing and token output.

Nothing outside this subpackage imports it. ``shelfmetrics.llm.registry`` lists its queries.
"""
