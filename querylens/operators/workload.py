"""Aggregate views of an export: profile cells, repeats, recurrence, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DIMENSIONS, bucket, length_class, nfc, normalized, once, surface, with_dimensions, words
from ..shared import materialize, spread
from .gate import release

REPEAT_BOUNDS, RESULT_BOUNDS = (0, 1, 2, 5, 10, 20, 50, 100), (0, 1, 5, 10, 25, 50, 100)
CHANNEL_ROWS = 100


def with_request_key(rows: DataFrame) -> DataFrame:
    """Adds norm and filters: the identity of a request, without its source."""
    rows = rows.withColumn("norm", nfc(F.col("text")))
    return rows.withColumn("norm", F.expr(normalized("norm", operators=False))).withColumn("filters", F.array_sort(F.array_distinct("packages")))


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of the least position for each key, by an aggregate (no sort, no window over a hot key)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "position").alias("_f")).select(*key, *(F.col(f"_f.{c}").alias(c) for c in rest))


def profile_counts(rows: DataFrame) -> DataFrame:
    """(view, dimension, source, category, n) of rows (position, source, text, packages, result_count, day), before the gate.

    A request's own dimensions depend on its text and filter alone, so they are
    measured once for each spelling, not for each row, and all cells of both
    views are counted in one aggregate. A request's first row is that of the
    least position; of rows that share it, the least in all other columns.
    """
    key, rest = ["source", "norm", "filters"], ["text", "packages", "result_count", "day"]
    spelt = with_request_key(rows).groupBy(*key, *rest).agg(F.count(F.lit(1)).alias("weight"), F.min("position").alias("position"))
    spelt = materialize(spread(spelt), "spellings")
    requests = materialize(spelt.groupBy(*key).agg(F.sum("weight").alias("times"), F.min(F.struct("position", *rest)).alias("first")), "requests")
    same = reduce(lambda x, y: x & y, (F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key))
    events = spelt.alias("s").join(requests.alias("r"), same).select("s.*", "r.times", "r.first")
    events = events.withColumn("is_first", F.struct("position", *rest).eqNullSafe(F.col("first"))).drop("first")
    events = with_dimensions(events, "text", "packages")
    result = f"case when result_count is null then 'missing' else {bucket('result_count', RESULT_BOUNDS)} end"
    events = events.withColumns({"repeats": F.expr(bucket("times", REPEAT_BOUNDS)), "results": F.expr(result)})
    own = [*DIMENSIONS, "repeats"]
    more = {"results": F.col("results"), "day": F.col("day").cast("string"), "weekday": F.date_format("day", "EEEE"), "surface_results": F.concat_ws(" / ", "surface", "results"), "intent_results": F.concat_ws(" / ", "intent_cue", "results")}

    def cell(view: str, dimension: str, category, n):
        return F.struct(F.lit(view).alias("view"), F.lit(dimension).alias("dimension"), category.alias("category"), n.alias("n"))

    every = {**{c: F.col(c) for c in own}, **more, "source": F.lit("requests")}
    once_ = {**{c: F.col(c) for c in own}, "source": F.lit("requests")}
    cells = F.concat(
        F.array(*(cell("events", d, c, F.col("weight")) for d, c in every.items())),
        F.when(F.col("is_first"), F.array(*(cell("distinct_requests", d, c, F.lit(1).cast("long")) for d, c in once_.items()))).otherwise(F.array()),
    )
    counted = events.select("source", F.explode(cells).alias("c")).groupBy("c.view", "c.dimension", "source", "c.category").agg(F.sum("c.n").alias("n"))
    out = [counted]
    for name, key in (("distinct_texts", ["norm"]), ("distinct_requests", ["norm", "filters"])):
        n = requests.select(*key).distinct().agg(F.count(F.lit(1)).alias("n"))
        out.append(n.select(F.lit("global").alias("view"), F.lit(name).alias("dimension"), F.lit("all").alias("source"), F.lit(name).alias("category"), "n"))
    return reduce(DataFrame.unionByName, out)


def profile(rows: DataFrame, min_count: int = 10) -> DataFrame:
    """The gated profile: view, dimension, source, category, count."""
    return release(profile_counts(rows), ["view", "dimension"], min_count)


def workload_counts(rows: DataFrame) -> DataFrame:
    """(win, channel, measure, category, n): counts of all measures for each window, of all sources and of each large enough one.

    Rows are counted by source, day and request first; only these counts are
    dealt to windows and channels, and each measure is a cell of one aggregate.
    """
    keyed = with_request_key(rows).withColumns({"surface": F.expr(surface("text")), "length": F.expr(once(words("text"), length_class)), "has": F.when(F.size("packages") > 0, "with_filter").otherwise("without_filter")})
    dims = ["surface", "length", "has"]
    daily = keyed.groupBy("source", "day", "norm", "filters", *dims).agg(
        F.count(F.lit(1)).alias("times"), F.min("result_count").alias("low"), F.max("result_count").alias("high"),
        F.count(F.when(F.col("result_count").isNull(), 1)).alias("unknown"), F.min("position").alias("position"),
    )
    daily = materialize(daily, "daily")
    first = daily.agg(F.min("day").alias("first"))  # one row
    both = daily.crossJoin(F.broadcast(first)).select(
        *daily.columns, F.explode(F.expr("array('full', if(day = first, 'first_day', 'later'))")).alias("win")
    ).withColumn("channel", F.explode(F.array(F.lit("all"), F.concat(F.lit("channel:"), "source"))))
    large = both.groupBy("win", "channel").agg(F.sum("times").alias("rows")).where(f"channel = 'all' or rows >= {CHANNEL_ROWS}")
    both = both.join(large.select("win", "channel"), ["win", "channel"], "left_semi")
    groups = both.groupBy("win", "channel", "norm", "filters").agg(
        F.sum("times").alias("times"), F.min("day").alias("from"), F.max("day").alias("to"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("unknown").alias("unknown"),
        F.min_by(F.struct(*dims), "position").alias("f"),
    )

    def cells(df: DataFrame, made: list[tuple]) -> DataFrame:
        every = F.array(*(F.struct(F.lit(m).alias("measure"), c.alias("category"), n.cast("long").alias("n")) for m, c, n in made))
        return df.select("win", "channel", F.explode(F.filter(every, lambda c: c["n"].isNotNull())).alias("c")).groupBy("win", "channel", "c.measure", "c.category").agg(F.sum("c.n").alias("n"))

    one, times = F.lit(1), F.col("times")
    by = dict(zip(("surface", "length", "filters"), dims, strict=True))
    of_groups = [
        ("requests", F.lit("requests"), times),
        ("repeat_accounting", F.lit("distinct"), one),
        ("repeat_accounting", F.lit("extra_occurrences"), times - 1),
        ("frequency_events", F.expr("case when times = 1 then 'once' when times <= 5 then '2-5' else '6+' end"), times),
        ("recurrence_distinct", F.expr("if(`from` = `to`, 'one_day', 'multiple_days')"), one),
        ("repeated_result_counts", F.expr("case when unknown > 0 then 'missing' when low = high then 'same_count' else 'different_counts' end"), F.when(times >= 2, one)),
        *((f"distinct/{m}", F.col(f"f.{c}"), one) for m, c in by.items()),
    ]
    return cells(groups, of_groups).unionByName(cells(both, [(f"requests/{m}", F.col(c), times) for m, c in by.items()]))


def workload(rows: DataFrame) -> DataFrame:
    """The gated summary in long form: win, channel, measure, category, count. A count of nothing is shown as 0."""
    counted = workload_counts(rows).withColumn("source", F.lit("all"))
    at = ["win", "channel", "measure"]
    shown = release(counted.where("n > 0 and measure <> 'requests'"), at).drop("source")
    zero = counted.where("n = 0 and measure <> 'requests'").select(*at, "category", F.lit(0).cast("long").alias("count"))
    total = counted.where("measure = 'requests'").select(*at, "category", F.expr("case when n >= 10 then cast(floor((n + 5) / 10) * 10 as bigint) end").alias("count"))
    return shown.unionByName(zero).unionByName(total)


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds times: how often the row's request comes from its source."""
    keyed = with_request_key(rows)
    return keyed.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("source", "norm", "filters")))
