"""Operators for building training corpora: cleaning, deduplication, filtering and mixing.

Nothing else in the package imports this subpackage; ``queries`` registers one query per operator.
"""
