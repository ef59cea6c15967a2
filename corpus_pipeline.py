"""The training-data pipeline of ``spanforge.llm`` at the top of the repository."""

from spanforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
