"""Scores of ranked retrieval runs against graded judgments.

All tables are long: run (q, doc, rank), qrels (q, doc, grade), collection (q,
group_id, track, answerability, status, abstained, latency_ms, cost_usd). A
metric that does not apply to a query has no row, which is not a zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10)
RELEVANT = 2
PREMISE_METRICS = ("best_route_group_recall", "route_covered")
METRICS = ("ndcg", "recall", "success", "mrr", "map", "precision", "judged")


def at_cutoffs(df: DataFrame, cutoffs: tuple[int, ...], rank: str = "rank") -> DataFrame:
    """Each row under each cutoff that it is within."""
    ks = F.array(*(F.lit(k) for k in cutoffs))
    return df.withColumn("k", F.explode(F.filter(ks, lambda k: k >= F.col(rank))))


def ranking_metrics(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(q, k, ndcg, recall, success, mrr, map, precision, judged) of every query with a relevant document.

    A document that comes again keeps its rank but gains once; unjudged
    documents gain nothing; a query without a ranking scores zero.
    """
    if not cutoffs or any(type(k) is not int or k < 1 for k in cutoffs):
        raise ValueError("cutoffs must be positive integers")
    deepest = max(cutoffs)
    by_grade = Window.partitionBy("q").orderBy(F.desc("grade"), "doc")
    ideal = qrels.withColumn("rank", F.row_number().over(by_grade)).where(F.col("rank") <= deepest)
    ideal = at_cutoffs(ideal, cutoffs).groupBy("q", "k").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("idcg"))
    relevant = qrels.where(F.col("grade") >= RELEVANT).groupBy("q").agg(F.count(F.lit(1)).alias("nrel"))
    # within the deepest cutoff the first place of a document is its place within each cutoff that reaches it
    first = run.where(F.col("rank") <= deepest).groupBy("q", "doc").agg(F.min("rank").alias("rank"))
    graded = first.join(qrels, ["q", "doc"], "left").withColumns({"hit": (F.coalesce("grade", F.lit(0)) >= RELEVANT).cast("int"), "judged": F.col("grade").isNotNull().cast("int")})
    hits = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    graded = graded.withColumn("hits", F.sum("hit").over(hits))
    gained = at_cutoffs(graded, cutoffs).groupBy("q", "k").agg(
        F.sum(F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("hit").alias("hit"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("ap"), F.sum("judged").alias("judged"),
    )
    wanted = relevant.withColumn("k", F.explode(F.array(*(F.lit(k) for k in cutoffs))))
    return wanted.join(ideal, ["q", "k"], "left").join(gained, ["q", "k"], "left").select(
        "q", "k", F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.col("hit") / F.col("nrel"), F.lit(0.0)).alias("recall"),
        F.coalesce((F.col("hit") > 0).cast("double"), F.lit(0.0)).alias("success"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("ap") / F.least("k", "nrel"), F.lit(0.0)).alias("map"), F.coalesce(F.col("hit") / F.col("k"), F.lit(0.0)).alias("precision"), F.coalesce(F.col("judged") / F.col("k"), F.lit(0.0)).alias("judged"),
    )


def premise_metrics(run: DataFrame, routes: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(q, k, best_route_group_recall, route_covered) of routes (q, route, grp, doc): any document of a group will do, routes are not mixed."""
    ks = F.explode(F.array(*(F.lit(k) for k in cutoffs))).alias("k")
    best = run.groupBy("q", "doc").agg(F.min("rank").alias("rank"))
    met = routes.join(best, ["q", "doc"], "left").groupBy("q", "route", "grp").agg(F.min("rank").alias("rank"))
    share = met.select("*", ks).groupBy("q", "route", "k").agg(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))).alias("share"))
    return share.groupBy("q", "k").agg(F.max("share").alias("best_route_group_recall"), F.max((F.col("share") == 1).cast("double")).alias("route_covered"))


def outcomes(collection: DataFrame, run: DataFrame) -> DataFrame:
    """(q, metric, value) of the requests themselves: success, abstention, return without an answer."""
    returned = run.select("q").distinct().withColumn("returned", F.lit(True))
    c = collection.join(returned, "q", "left").withColumn("ok", F.coalesce(F.col("status") == "ok", F.lit(False)))
    c = c.withColumn("quiet", F.coalesce(F.col("abstained"), F.lit(False)) & F.col("ok"))
    metric = F.expr("""explode(filter(array(
        struct('request_success' as metric, cast(ok as double) as value),
        if(answerability = 'answerable', struct('false_abstention' as metric, cast(quiet as double) as value), null),
        if(answerability = 'unanswerable', struct('correct_abstention' as metric, cast(quiet as double) as value), null),
        if(answerability = 'unanswerable', struct('false_return' as metric, cast(coalesce(returned, false) as double) as value), null)), x -> x is not null))""")
    return c.select("q", metric.alias("m")).select("q", "m.metric", "m.value")


def unavailable(cutoffs: tuple[int, ...], max_k: int | None) -> list[int]:
    """The cutoffs that a run is too shallow for; they are reported, not scored."""
    return [k for k in cutoffs if max_k is not None and k > max_k]


def _long(wide: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(q, metric@k, value) of one column for each metric."""
    long = wide.select("q", "k", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m"))
    return long.select("q", F.concat("m.metric", F.lit("@"), "k").alias("metric"), "m.value")


def query_scores(collection: DataFrame, run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, max_k: int | None = None, routes: DataFrame | None = None) -> DataFrame:
    """(q, metric, value): all scores of all scheduled queries; cutoffs deeper than max_k are unavailable() and have no row.

    Answerable queries that have routes (q, route, grp, doc) are scored by them as well.
    """
    usable = tuple(k for k in cutoffs if k not in unavailable(cutoffs, max_k))
    answerable = collection.where("answerability = 'answerable'").select("q")
    parts = [outcomes(collection, run)]
    if usable:
        parts.append(_long(ranking_metrics(run, qrels.join(answerable, "q", "left_semi"), usable), METRICS))
        if routes is not None:
            parts.append(_long(premise_metrics(run, routes.join(answerable, "q", "left_semi"), usable), PREMISE_METRICS))
    return reduce(DataFrame.unionByName, parts)


def track_summary(collection: DataFrame, scores: DataFrame) -> DataFrame:
    """(track, metric, mean, n) for each track and for all of them."""
    tracked = scores.join(collection.select("q", "track"), "q")
    both = tracked.groupBy("track", "metric").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    total = both.groupBy(F.lit("all").alias("track"), "metric").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return both.unionByName(total).select("track", "metric", (F.col("s") / F.col("n")).alias("mean"), "n")


def track_costs(collection: DataFrame) -> DataFrame:
    """(track, scheduled, independent_groups, latency_n, p50, p95, p99, cost_n, cost_total); the total is null if nothing is known."""
    both = collection.withColumn("track", F.explode(F.array(F.lit("all"), "track")))
    return both.groupBy("track").agg(
        F.count(F.lit(1)).alias("scheduled"), F.countDistinct("group_id").alias("independent_groups"), F.count("latency_ms").alias("latency_n"),
        *(F.expr(f"percentile(latency_ms, {p})").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))), F.count("cost_usd").alias("cost_n"), F.sum("cost_usd").alias("cost_total"),
    )


def binary_metrics(run: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(q, hit, recall, mrr, ndcg) with binary gain; a repeated document counts each time that it comes."""
    found = run.where(F.col("rank") <= k).join(relevant, ["q", "doc"], "left_semi").groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.groupBy("q").agg(F.countDistinct("doc").alias("nrel"))
    ideal = f"aggregate(sequence(1, cast(least({k}, nrel) as int)), 0D, (s, i) -> s + 1 / log2(i + 1))"
    return wanted.join(found, "q", "left").select(
        "q", F.coalesce((F.col("n") > 0).cast("double"), F.lit(0.0)).alias("hit"), F.coalesce(F.col("n") / F.col("nrel"), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / F.expr(ideal), F.lit(0.0)).alias("ndcg"),
    )


def stage_metrics(trace: DataFrame, relevant: DataFrame) -> DataFrame:
    """(q, stage, k, hit, recall, mrr, ndcg, first_rank) of a trace (q, stage, id, rank): binary gain at the depth of each stage's own list, one at least.

    Only stages that a query has reached have a row.
    """
    deep = trace.groupBy("q", "stage").agg(F.greatest(F.max("rank"), F.lit(1)).alias("k"))
    found = trace.join(relevant.select("q", F.col("doc").alias("id")), ["q", "id"], "left_semi").groupBy("q", "stage").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.groupBy("q").agg(F.countDistinct("doc").alias("nrel"))
    ideal = "aggregate(sequence(1, cast(least(k, nrel) as int)), 0D, (s, i) -> s + 1 / log2(i + 1))"
    return deep.join(wanted, "q").join(found, ["q", "stage"], "left").select(
        "q", "stage", "k", F.coalesce((F.col("n") > 0).cast("double"), F.lit(0.0)).alias("hit"), F.coalesce(F.col("n") / F.col("nrel"), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / F.expr(ideal), F.lit(0.0)).alias("ndcg"), "first_rank",
    )


def relevant_ranks(trace: DataFrame, relevant: DataFrame) -> DataFrame:
    """(q, stage, id, rank): the first place of each relevant document in each stage that holds it."""
    return trace.join(relevant.select("q", F.col("doc").alias("id")).distinct(), ["q", "id"]).groupBy("q", "stage", "id").agg(F.min("rank").alias("rank"))


def variant_summary(records: DataFrame) -> DataFrame:
    """(variant, category, queries, runs, hit, recall, mrr, ndcg, candidate_recall, p50, p95) of records, for each category and all.

    p95 is the nearest rank; a record without a candidate stage counts as recall 0.
    """
    both = records.withColumn("category", F.explode(F.array(F.lit("__all__"), "category")))
    return both.groupBy("variant", "category").agg(
        F.countDistinct("q").alias("queries"), F.count(F.lit(1)).alias("runs"), *(F.avg(m).alias(m) for m in ("hit", "recall", "mrr", "ndcg")), F.avg(F.coalesce("candidate_recall", F.lit(0.0))).alias("candidate_recall"),
        F.median("latency_ms").alias("latency_p50_ms"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("latency_p95_ms"),
    )


def violations(collection: DataFrame, run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(rule, violations): the rules that a collection and a run must keep, each with its count."""
    best = qrels.groupBy("q").agg(F.max("grade").alias("best"))
    c = collection.join(best, "q", "left")
    bad = {
        "null id": "q is null", "null group": "group_id is null", "null track": "track is null",
        "unknown answerability": "answerability is null or answerability not in ('answerable', 'unanswerable', 'unknown')",
        "answerable without a relevant document": f"answerability = 'answerable' and coalesce(best, 0) < {RELEVANT}",
        "unanswerable with a relevant document": f"answerability = 'unanswerable' and best >= {RELEVANT}",
        "unknown status": "status is not null and status not in ('ok', 'error', 'timeout')",
        "abstained without success": "abstained and coalesce(status, 'missing') <> 'ok'",
        "negative or infinite latency": "latency_ms < 0 or isnan(latency_ms) or latency_ms = double('infinity')",
        "negative or infinite cost": "cost_usd < 0 or isnan(cost_usd) or cost_usd = double('infinity')",
    }
    one = c.agg(*(F.count_if(F.coalesce(F.expr(e), F.lit(False))).alias(r) for r, e in bad.items()))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in bad))).alias("x")).select("x.*")
    more = [
        collection.groupBy("q").count().where("count > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("duplicate id").alias("rule"), "violations"),
        run.select("q").distinct().join(collection, "q", "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("run of an unknown query").alias("rule"), "violations"),
        qrels.agg(F.count_if(~F.col("grade").between(0, 3)).alias("violations")).select(F.lit("grade out of range").alias("rule"), "violations"),
        run.agg(F.count_if(F.col("rank") < 1).alias("violations")).select(F.lit("rank below 1").alias("rule"), "violations"),
    ]
    return reduce(DataFrame.unionByName, more, long)


def check(collection: DataFrame, run: DataFrame, qrels: DataFrame) -> None:
    """Raise on the first broken rules."""
    broken = violations(collection, run, qrels).where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))
