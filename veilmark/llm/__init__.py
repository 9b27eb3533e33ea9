"""Operators of a training-data pipeline: token files, cleaning, joins, filters, packing, sharding.

Nothing outside this package imports it; deleting it (with ``tests/llm`` and
``corpus_pipeline.py``) leaves the rest of the library whole.
"""
