"""Documents to tokens: the stages that ``adclick.llm.pipeline`` holds."""

from adclick.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
