"""Paired comparison of two runs: effect, cluster bootstrap, sign randomisation, Holm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differences(base: DataFrame, candidate: DataFrame, base_qrels: DataFrame, candidate_qrels: DataFrame) -> DataFrame:
    """(rule, violations): what keeps two evaluations from being compared. Collections are (q, track, group_id, answerability), judgments (q, doc, grade)."""
    same = ["track", "group_id", "answerability"]
    a, b = (c.select("q", F.struct(*same).alias(n), F.lit(True).alias(f"has_{n}")) for c, n in ((base, "a"), (candidate, "b")))
    both = a.join(b, "q", "full_outer").agg(
        F.count_if(F.col("has_a").isNull() | F.col("has_b").isNull()).alias("query scheduled on one side only"),
        F.count_if(F.col("has_a") & F.col("has_b") & ~F.col("a").eqNullSafe(F.col("b"))).alias("query metadata differ"),
    )
    a, b = (j.select("q", "doc", F.col("grade").alias(n)) for j, n in ((base_qrels, "ga"), (candidate_qrels, "gb")))
    judged = a.join(b, ["q", "doc"], "full_outer").agg(F.count_if(~F.col("ga").eqNullSafe(F.col("gb"))).alias("judgments differ"))
    one = both.crossJoin(judged)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in one.columns))).alias("x")).select("x.*")


def check_comparable(base: DataFrame, candidate: DataFrame, base_qrels: DataFrame, candidate_qrels: DataFrame, revisions: tuple[str | None, str | None] = (None, None)) -> None:
    """Raise unless both evaluations are of one corpus, the same queries with the same metadata, and the same judgments."""
    if revisions[0] != revisions[1]:
        raise ValueError("corpus revisions differ")
    broken = differences(base, candidate, base_qrels, candidate_qrels).where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))


def paired(collection: DataFrame, base: DataFrame, candidate: DataFrame, metric: str, track: str = "all") -> DataFrame:
    """(group_id, s, n): sums of candidate minus baseline over a group's queries, of one track or all. Both sides must score the same queries."""
    if track != "all":
        collection = collection.where(F.col("track") == track)
        base, candidate = (x.join(collection.select("q"), "q", "left_semi") for x in (base, candidate))
    a = base.where(F.col("metric") == metric).select("q", F.col("value").alias("a"))
    b = candidate.where(F.col("metric") == metric).select("q", F.col("value").alias("b"))
    both = a.join(b, "q", "full_outer")
    if not both.where("a is null or b is null").isEmpty():
        raise ValueError("metric coverage differs between runs")
    return both.join(collection.select("q", "group_id"), "q").groupBy("group_id").agg(F.sum(F.col("b") - F.col("a")).alias("s"), F.count(F.lit(1)).alias("n"))


def effect(groups: DataFrame) -> DataFrame:
    """One row: n_queries, n_groups, candidate_minus_baseline."""
    return groups.agg(F.sum("n").alias("n_queries"), F.count(F.lit(1)).alias("n_groups"), (F.sum("s") / F.sum("n")).alias("candidate_minus_baseline"))


def _guard(groups: DataFrame, samples: int) -> int:
    if samples < 100:
        raise ValueError("use at least 100 resamples")
    n = groups.count()
    if n < 2:
        raise ValueError("at least two independent groups are required")
    return n


#: Up to so many groups a resample draws exactly as many groups as there are.
EXACT_GROUPS = 4_096


def bootstrap_interval(groups: DataFrame, samples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: the 2.5 and 97.5 percentiles of the effect over resampled groups.

    Up to EXACT_GROUPS groups, which fit one row, each resample draws as many
    groups as there are, with replacement. Beyond that each group draws its multiplicity for each resample from its own Poisson(1)
    counter, which is how resampling with replacement looks from one group when there
    are many; no resample is ever gathered in one place, and sums combine on the
    map side.
    """
    n = _guard(groups, samples)
    if n <= EXACT_GROUPS:
        held = groups.agg(F.sort_array(F.collect_list(F.struct("group_id", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n")))).alias("g"))  # one row
        drawn = f"aggregate(sequence(0, {n - 1}), named_struct('s', 0D, 'n', 0D), (a, i) -> transform(array(g[cast(pmod(xxhash64({seed}, rep, i), {n}) as int)]), x -> named_struct('s', a.s + x.s, 'n', a.n + x.n))[0], a -> a.s / a.n)"
        cores = groups.sparkSession.sparkContext.defaultParallelism
        sums = groups.sparkSession.range(0, samples, 1, cores).withColumnRenamed("id", "rep").crossJoin(F.broadcast(held)).select(F.expr(drawn).alias("x"))
        return sums.agg(F.expr("percentile(x, 0.025)").alias("low"), F.expr("percentile(x, 0.975)").alias("high"))
    u = "(pmod(xxhash64({seed}, rep, group_id), 1000000007) + 0.5D) / 1000000007D".format(seed=seed)
    # inverse of the Poisson(1) distribution function
    steps, cumulative, p = [], 0.0, 2.718281828459045**-1
    for k in range(10):
        cumulative += p
        steps.append(f"when u <= {cumulative!r}D then {k}")
        p /= k + 1
    drawn = groups.select("group_id", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("rep")).withColumn("u", F.expr(u)).withColumn("times", F.expr(f"case {' '.join(steps)} else 10 end"))
    sums = drawn.groupBy("rep").agg((F.sum(F.col("s") * F.col("times")) / F.nullif(F.sum(F.col("n") * F.col("times")), F.lit(0))).alias("x"))
    return sums.agg(F.expr("percentile(x, 0.025)").alias("low"), F.expr("percentile(x, 0.975)").alias("high"))


def sign_randomization(groups: DataFrame, samples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: p of the two-sided test that flips whole groups, (extreme + 1) / (samples + 1)."""
    _guard(groups, samples)
    flipped = groups.select("group_id", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("rep"))
    sign = F.expr(f"if(pmod(xxhash64({seed}, rep, group_id), 2) = 0, 1, -1)")
    sums = flipped.groupBy("rep").agg((F.sum(sign * F.col("s")) / F.sum("n")).alias("x"))
    seen = effect(groups).select(F.col("candidate_minus_baseline").alias("o"))
    extreme = sums.crossJoin(F.broadcast(seen)).agg(F.count_if(F.expr("abs(x) >= abs(o) - 1e-15")).alias("e"))
    return extreme.select(((F.col("e") + 1) / F.lit(samples + 1)).alias("p"))


def exact_sign_p(groups: DataFrame) -> float:
    """The same test over all 2^n assignments, for 16 groups at most."""
    rows = groups.limit(17).collect()
    if len(rows) > 16:
        raise ValueError("too many groups to enumerate")
    s = [float(r["s"]) for r in rows]
    seen = abs(sum(s))
    count = sum(abs(sum(x if m >> i & 1 else -x for i, x in enumerate(s))) >= seen - 1e-15 * sum(r["n"] for r in rows) for m in range(2 ** len(s)))
    return count / 2 ** len(s)


def holm(p: DataFrame, family: list[str] | None = None) -> DataFrame:
    """Adds adjusted to rows (id, p): Holm's step-down over a family of comparisons."""
    if not p.where("p is null or isnan(p) or p < 0 or p > 1").isEmpty():
        raise ValueError("invalid p-value")
    w = Window.partitionBy(*(family or [F.lit(1)]))
    ranked = p.withColumn("r", F.row_number().over(w.orderBy("p", "id"))).withColumn("m", F.count(F.lit(1)).over(w))
    up = w.orderBy("p", "id").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("adjusted", F.max(F.least(F.lit(1.0), (F.col("m") - F.col("r") + 1) * F.col("p"))).over(up)).drop("r", "m")
