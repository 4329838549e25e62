"""The corpus pipeline of querylens.llm: its stages, and a run of all of them."""

from querylens.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
