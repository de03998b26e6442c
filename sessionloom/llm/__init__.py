"""Training-data operators: search, language, deduplication, archives, filtering, packing.

Nothing outside this folder imports it; ``queries`` holds what is registered.
"""
