"""Training-data operators: formatting, dedup, classification, search, mixing, tokens, sharding.

Nothing else in the library imports this subpackage.
"""
