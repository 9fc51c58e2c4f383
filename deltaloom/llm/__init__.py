"""Operators for large training-data corpora.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
this subpackage; it can be removed without touching the rest of the library.
"""
