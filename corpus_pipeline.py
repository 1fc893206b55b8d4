"""A corpus pipeline of five operators: language ID, quality rules, near-dedup, mixing, packing. The stages are in cyclemill.llm.stages,
which says what each does in odd cases; run(spark, sf_dir) applies them to documents, each to what the one before has stored."""

from __future__ import annotations

from cyclemill.llm.stages import ORACLE_SQL, STAGES, distinct, identified, mixed, of_quality, packed, run

__all__ = ["ORACLE_SQL", "STAGES", "distinct", "identified", "mixed", "of_quality", "packed", "run"]
