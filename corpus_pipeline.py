"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL``, as ``streetflow.llm.pipeline`` defines them."""

from streetflow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
