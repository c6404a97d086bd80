"""Operators of a training-data pipeline: filtering, deduplication, search, mixing, tokenising.

Nothing outside this package imports it.  ``catalog`` collects the registered queries.
"""
