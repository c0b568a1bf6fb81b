"""Training-data operators: deduplication, classification, packing, mixing, search, tokens, media.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
