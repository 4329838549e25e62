"""Disclosure gates: small cells and a complementary cell are hidden, shown counts are rounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MIN_COUNT, rounded

#: Columns that hold query text and may never key a released table.
TEXT_COLUMNS = frozenset({"query", "normalized", "packages", "text"})
SUPPRESSED = "<suppressed>"


def _hidden(counted: DataFrame, table: list[str], order: list[str], least: int, more_than: int) -> DataFrame:
    """Marks small cells, and the next smallest where just one is small and there are more than so many cells.

    counted has one row for each cell, so these windows are over a small table.
    """
    all_ = Window.partitionBy(*table) if table else Window.partitionBy(F.lit(1))
    w = counted.withColumns({"_r": F.row_number().over(all_.orderBy("n", *order)), "_small": F.sum((F.col("n") < least).cast("int")).over(all_), "_cells": F.count(F.lit(1)).over(all_)})
    return w.withColumn("_hid", (F.col("n") < least) | ((F.col("_small") == 1) & (F.col("_cells") > more_than) & (F.col("_r") == 2)))


def releasable_counts(df: DataFrame, by: list[str], min_count: int = MIN_COUNT, base: int = 10) -> DataFrame:
    """The log's gate: by, n. Hidden cells are pooled in one row, whose count shows only if it is large enough.

    One small cell alone takes the next smallest with it if there are more than
    two cells. Null keys are a group. Keys that hold query text are refused.
    """
    refused = sorted(TEXT_COLUMNS & set(by))
    if refused:
        raise ValueError(f"counts keyed by {refused} hold query text")
    marked = _hidden(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), [], by, min_count, 2)
    kept = marked.where("not _hid").select(*(F.col(c).cast("string").alias(c) for c in by), F.expr(rounded("n", base)).alias("n"))
    pooled = marked.where("_hid").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).where("c > 0")
    pooled = pooled.select(*(F.lit(SUPPRESSED).alias(c) for c in by), F.expr(f"case when n >= {min_count} then {rounded('n', base)} end").alias("n"))
    return kept.unionByName(pooled)


def shown(released: DataFrame) -> DataFrame:
    """A released table without its pooled row, for drawings that have no place for it."""
    keys = [c for c, t in released.dtypes if t == "string"]
    return released.where(" and ".join(f"coalesce(`{c}`, '') not in ('{SUPPRESSED}', 'suppressed')" for c in keys) or "true")


def release(counted: DataFrame, table: list[str], min_count: int = MIN_COUNT) -> DataFrame:
    """The export's gate over cells (table columns, source, category, n): table columns, source, category, count.

    Each table is gated by itself; one small cell alone takes the next smallest
    with it whenever there is one.
    """
    if min_count < MIN_COUNT:
        raise ValueError(f"min_count must be at least {MIN_COUNT}")
    marked = _hidden(counted, table, ["source", "category"], min_count, 1)
    kept = marked.where("not _hid").select(*table, "source", "category", F.expr(rounded("n")).alias("count"))
    pooled = marked.where("_hid").groupBy(*table, F.lit("suppressed").alias("source"), F.lit("suppressed").alias("category")).agg(F.sum("n").alias("n"))
    return kept.unionByName(pooled.select(*table, "source", "category", F.expr(f"case when n >= {min_count} then {rounded('n')} end").alias("count")))


def release_sql(counted: str, table: list[str], least: int = MIN_COUNT, prefix: str = "") -> str:
    """release() as common table expressions in SQL, ending in <prefix>released."""
    keys = "".join(f"{c}, " for c in table)
    part = f"partition by {', '.join(table)}" if table else ""
    return f"""{prefix}ranked as (select *, row_number() over ({part} order by n, source, category) as r_, sum(case when n < {least} then 1 else 0 end) over ({part}) as small_,
        count(*) over ({part}) as cells_ from {counted}),
    {prefix}marked as (select *, n < {least} or (small_ = 1 and cells_ > 1 and r_ = 2) as hid_ from {prefix}ranked),
    {prefix}released as (select {keys}source, category, cast(floor((n + 5) / 10.0) * 10 as bigint) as "count" from {prefix}marked where not hid_
        union all select {keys}'suppressed', 'suppressed', case when sum(n) >= {least} then cast(floor((sum(n) + 5) / 10.0) * 10 as bigint) end
        from {prefix}marked where hid_ {'group by ' + ', '.join(table) if table else 'having count(*) > 0'})"""
