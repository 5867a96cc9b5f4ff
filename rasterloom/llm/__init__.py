"""Training-data operators: scoring, deduplication, filtering, mixing, packing and token output.

Nothing outside this folder imports it; the query registry adds its queries
only when the folder is present.
"""
