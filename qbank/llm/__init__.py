"""Training-data pipeline operators.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it; the
rest of the library works without it.
"""
