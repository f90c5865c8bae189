"""Training-data operators: scoring, formatting, filtering, deduplication, mixing, tokens and search.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
