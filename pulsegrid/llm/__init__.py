"""Operators for preparing training text: sharding, packing, formatting, filtering, search and near-duplicates.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
