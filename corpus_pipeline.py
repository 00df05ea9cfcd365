"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, packing. See kerbside/llm/pipeline.py."""

from kerbside.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
