"""Training-data operators: tokenising, filtering, deduplication, search, formatting and output.

Nothing else in :mod:`geolake` imports this subpackage.
"""
