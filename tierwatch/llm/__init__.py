"""Operators over text corpora: cleaning, deduplication, scoring, tokens and packing.

Nothing else in the library imports this subpackage.
"""
