"""A training corpus from the documents table: five stages, each an operator of pagelantern.llm (see llm/pipeline.py)."""

from __future__ import annotations

from pagelantern.llm.pipeline import COLUMNS, STAGES, near_duplicates, run

ORACLE_SQL = None  # no stage but mixing can be told in SQL; the tests hold the stages against brute force

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "near_duplicates", "run"]
