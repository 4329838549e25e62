"""Stratified samples for review, and checks of review labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import surface
from .workload import _first, with_request_key

#: The axes of review labels and what each may hold.
AXES = {
    "intent": ("known_item", "find_lemma", "next_proof_step", "premise_bundle", "definition_or_api", "usage_example", "explanation", "exploration", "formalization", "debugging", "multiple", "unknown"),
    "actor": ("unknown", "human_confirmed", "agent_confirmed"),
    "certainty": ("clear", "ambiguous", "insufficient_context"),
    "evidence": ("annotator_inference", "user_self_report", "client_attestation"),
    "language": ("english", "other", "formal_only", "mixed", "unknown"),
    "expected_output": ("declaration", "premise_set", "proof_step", "proof", "explanation", "example", "multiple", "unknown"),
}


def quotas(sizes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Adds quota to strata (keys..., n): one slot after the other goes to each stratum in turn while it has rows.

    In each round r every stratum with r or more rows gets a slot. So the last full round is found from
    counts of strata by size, and strata are never exploded into rows.
    """
    if size < 1:
        raise ValueError("sample size must be positive")
    all_ = Window.partitionBy(F.lit(1))
    # with sizes ascending, a full level n_i costs sum of the smaller ones plus n_i for all the rest
    s = sizes.withColumn("_r", F.row_number().over(all_.orderBy("n", *keys))).withColumn("_c", F.count(F.lit(1)).over(all_))
    s = s.withColumn("_below", F.coalesce(F.sum("n").over(all_.orderBy("n", *keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_fits", F.col("_below") + F.col("n") * (F.col("_c") - F.col("_r") + 1) <= size)
    s = s.withColumn("_done", F.sum(F.when(F.col("_fits"), F.col("n")).otherwise(0)).over(all_)).withColumn("_open", F.sum((~F.col("_fits")).cast("int")).over(all_))
    s = s.withColumn("_left", F.lit(size) - F.col("_done"))
    s = s.withColumn("_each", F.when(F.col("_open") > 0, F.floor(F.col("_left") / F.col("_open"))).otherwise(0)).withColumn("_more", F.when(F.col("_open") > 0, F.col("_left") % F.col("_open")).otherwise(0))
    turn = F.sum((~F.col("_fits")).cast("int")).over(all_.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_turn", turn)
    quota = F.when(F.col("_fits"), F.col("n")).otherwise(F.col("_each") + (F.col("_turn") <= F.col("_more")).cast("int"))
    return s.select(*keys, "n", quota.cast("long").alias("quota"))


def review_sample(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(position, source, surface, population, sampled): distinct requests, balanced over source and surface, chosen by hash."""
    first = _first(with_request_key(rows).select("position", "source", "norm", "filters", "text"), ["source", "norm", "filters"]).withColumn("surface", F.expr(surface("text")))
    strata = quotas(first.groupBy("source", "surface").agg(F.count(F.lit(1)).alias("n")), ["source", "surface"], size)
    order = Window.partitionBy("source", "surface").orderBy(F.xxhash64(F.lit(seed), "position"), "position")
    ranked = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).join(strata, ["source", "surface"]).where("r <= quota")
    return ranked.select("position", "source", "surface", F.col("n").alias("population"), F.col("quota").alias("sampled"))


def label_errors(annotations: DataFrame, axes: dict[str, tuple[str, ...]] = AXES) -> DataFrame:
    """(position, error) of annotations (position, evidence, actor, axes...): values off their list, actors without evidence."""
    rules = {f"unknown {a}": f"{a} is null or {a} not in ({', '.join(repr(v) for v in values)})" for a, values in axes.items()}
    rules["actor without evidence"] = "actor <> 'unknown' and (evidence is null or evidence = 'annotator_inference')"
    found = F.array(*(F.when(F.coalesce(F.expr(e), F.lit(False)), F.lit(r)) for r, e in rules.items()))
    return annotations.select("position", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("error"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, or all if there are fewer, in the order of a hash of their key, which is distinct.

    Rows are counted by the leading bits of the hash; whole ranges of it are
    taken until the n-th row's, and only that one is ranked.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_r", F.shiftright(F.col("_h"), 48))
    below = Window.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = hashed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0))).where(F.col("_before") < n)  # 65,536 rows at most
    met = hashed.join(F.broadcast(ranges.select("_r", "_n", "_before")), "_r")
    whole = met.where(F.col("_before") + F.col("_n") <= n)
    last = met.where(F.col("_before") + F.col("_n") > n).withColumn("_at", F.row_number().over(Window.partitionBy("_r").orderBy("_h", key))).where(F.col("_before") + F.col("_at") <= n)
    return whole.select(*df.columns).unionByName(last.select(*df.columns))


def group_sample(df: DataFrame, group: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, or all if there are fewer, in the order of a hash of their key; the engine drops the rest before the exchange."""
    order = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n).drop("_at")


def run_order(cases: DataFrame, keys: list[str], repetitions: int, seed: int = 42) -> DataFrame:
    """Each case in each repetition, with its place in that repetition's shuffled order."""
    every = cases.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    order = Window.partitionBy("repetition").orderBy(F.xxhash64(F.lit(seed), "repetition", *keys), *keys)
    return every.withColumn("place", F.row_number().over(order).cast("long"))


def with_strata(annotations: DataFrame, sample: DataFrame) -> DataFrame:
    """Annotations by position with the stratum, population and sample size of their request; those outside the sample have none."""
    return annotations.join(sample.select("position", "source", "surface", "population", "sampled"), "position", "left")
