"""Training-data operators: scoring, archives, decontamination, tokenisation, dedup, search, quality.

Nothing else in the library imports this subpackage.
"""
