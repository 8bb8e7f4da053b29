"""Loads every query module of the subpackage."""

from __future__ import annotations

from plumbline.llm import queries_dedup, queries_packing, queries_quality, queries_text  # noqa: F401
from plumbline.llm.registry import ORACLES, QUERIES  # noqa: F401
