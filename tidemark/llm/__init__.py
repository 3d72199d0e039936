"""Training-data operators: extraction, deduplication, classification, tokenisation, packing and search.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
