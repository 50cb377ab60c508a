"""Operators for training-data pipelines: scoring, dedup, mixing, decontamination and token files.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; :mod:`tidelog.llm.queries` holds the thin registered queries.
"""
