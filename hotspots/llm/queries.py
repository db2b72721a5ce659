"""Imports every module that registers queries of this subpackage."""

from __future__ import annotations

from hotspots.llm import queries_corpus, queries_models, queries_native, queries_records, queries_text  # noqa: F401
from hotspots.llm.catalog import ORACLE, QUERIES  # noqa: F401
