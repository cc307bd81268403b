"""Operators for preparing training corpora: archives, token files, deduplication, filters, packing.

Nothing outside this subpackage imports it.
"""
