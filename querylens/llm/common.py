"""What the operators share: table access, texts of a batch, and the one large table of a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from sys import getsizeof
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_table, materialize, new_folder, release_exchanges  # noqa: F401

_HELD: dict[Any, Any] = {}


def held_by_worker(name: Any, make: Callable[[], Any]) -> Any:
    """What an operator keeps from batch to batch in a Python worker; what another one has kept there goes."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


class Remembered(dict):
    """Values made of their keys, those that were asked for lately: at twice the given bytes the older half goes."""

    def __init__(self, make: Callable[[str], Any], most: int):
        super().__init__()
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def __missing__(self, key: str) -> Any:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        size = 100 + getsizeof(key) + getsizeof(out)  # and a place in the table
        if size > 1000:  # no word; it will hardly be met again
            return out
        if self.held + size > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = out
        return out


def texts(column: pa.Array) -> Iterator[str]:
    """The texts of a column one by one (a batch is bounded in bytes, so only one text more is held); null as empty."""
    return (t.as_py() or "" for t in column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need; clashing extra columns stay behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
