"""Tables of a report: headline numbers, counts over bins, the most repeated, categories, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from .groups import with_normal_form


def overview(log: DataFrame, base: int = numbers.BASE) -> DataFrame:
    """One row of headline numbers of a log whose groups are exact duplicates; shares come from rounded counts."""
    grouped = with_normal_form(log)
    per = grouped.groupBy("normalized").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result_count") == 0).alias("z"), F.count_if(F.size("packages") > 0).alias("f"))
    days = grouped.agg(F.countDistinct("collected_on").alias("days"))
    one = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("r"), F.sum("z").alias("z"), F.sum("f").alias("f")).crossJoin(days)
    total = numbers.rounded("n", base)
    return one.select(
        F.expr(total).alias("rows"), F.expr(numbers.rounded("d", base)).alias("distinct_queries"), "days",
        *(F.round(F.expr(f"cast({numbers.rounded(c, base)} as double) / nullif({total}, 0)"), 9).alias(a) for c, a in (("r", "share_rows_in_repeated_groups"), ("z", "zero_result_share"), ("f", "package_filter_share"))),
    )


def formatted(one: DataFrame) -> DataFrame:
    """(measure, value) of a row of numbers: shares as percentages, counts with commas."""
    cells = (F.struct(F.lit(c).alias("measure"), F.expr(numbers.percent(c) if t == "double" else numbers.thousands(c)).alias("value")) for c, t in one.dtypes)
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def counts_with_empty(df: DataFrame, bins: dict[str, tuple[str, ...]]) -> DataFrame:
    """(bins..., n): counts of two ordered bins; bins without rows are kept, unknown ones are groups of their own."""
    names = list(bins)
    n = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    (a, b), (rows, columns) = names, bins.values()
    grid = df.sparkSession.createDataFrame([(x, y) for x in rows for y in columns], f"{a} string, {b} string")
    known = F.broadcast(grid).join(n, names, "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"))
    return known.unionByName(n.where(f"{a} is null or {b} is null"))


def most_repeated(summary: DataFrame, n: int = 20) -> DataFrame:
    """The n groups with the most rows, the earlier group among equals."""
    return summary.select("group_id", "query", "n_rows").orderBy(F.desc("n_rows"), "group_id").limit(n)


def describe_categories(points: DataFrame, least: int = numbers.MIN_COUNT, skeletons: int = 3) -> DataFrame:
    """A row for each category of enough points: share, median words, means, its common skeletons; place is its place by category path."""
    total = points.agg(F.count(F.lit(1)).alias("total"))
    per = points.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.median("n_words").cast("double").alias("median_words"), F.round(F.avg("identifier_share"), 2).alias("identifier_share"), F.round(F.avg("function_word_share"), 2).alias("prose_share"), F.round(F.avg("symbol_share"), 2).alias("symbol_share")).where(F.col("n") >= least)
    best = points.groupBy("category", "skeleton").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "skeleton"))).where(F.col("r") <= skeletons)
    common = best.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "skeleton", "n"))), lambda x: F.concat(x["skeleton"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), " · ").alias("common_skeletons"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("category")).cast("long")  # a row for each category
    return per.crossJoin(total).join(common, "category", "left").select("category", place.alias("place"), F.round(100 * F.col("n") / F.col("total"), 2).alias("share_of_searches"), "median_words", "identifier_share", "prose_share", "symbol_share", F.coalesce("common_skeletons", F.lit("")).alias("common_skeletons"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """One row: requests and the sums of tokens and cost of calls (prompt_tokens, completion_tokens, cost); unknown ones count as nothing."""
    return calls.agg(F.count(F.lit(1)).alias("requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost")))
