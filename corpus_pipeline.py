"""The corpus pipeline; its stages are in parcelry.llm.pipeline."""

from parcelry.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
