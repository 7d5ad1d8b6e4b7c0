"""The corpus pipeline: four stages over `documents`, each one of the operators in `keyfold.llm`."""

from keyfold.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
