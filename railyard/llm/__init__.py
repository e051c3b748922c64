"""Training-data operators: dedup, joins, search, masking, tokenising, mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
