"""Operators that prepare text for training corpora.

Nothing outside this package imports it; its queries live in :mod:`attesta.llm.queries`.
"""
