"""Candidate retrieval in batch: lexical and vector top-k, fusion, cuts, a deterministic reranker.

The engine behind the pipeline that this follows is not public, so BM25's
parameters (k1 1.2, b 0.75, delta 1), reciprocal-rank fusion with k 60 and the
dependency boost are choices of ours.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dense_blocks, is_small, materialize
from . import ranking, sampling

K1, B, DELTA, RRF = 1.2, 0.75, 1.0, 60
DIMENSIONS = 64
#: Queries that go to every task at once.
QUERY_BLOCK = 4_096
WORDS = "regexp_extract_all(lower({}), '([a-z0-9]+)', 0)"
#: A name's tokens as they stand between blanks, and its parts: runs of letters and digits, cut where a capital follows a small letter.
RAW_WORDS = "regexp_extract_all(lower({}), '([^ ]+)', 0)"
SPLIT_WORDS = "regexp_extract_all(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '$1 $2')), '([a-z0-9]+)', 0)"
#: What names that no person wrote look like; the engine that this follows keeps its own rule to itself.
AUTOGENERATED = r"(^|[._])(match|proof|eq|rec|mk|aux)_[0-9]+$"


def _top(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each key, ranked; the engine drops the rest before the exchange."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 1000, text: str = "text", words: str = WORDS) -> DataFrame:
    """(q, id, score, rank) of queries (q, text) over docs (id, text): BM25+ over an inverted index, scores above 0 only."""
    tokens = docs.select("id", F.expr(words.format(text)).alias("w")).withColumn("len", F.size("w"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    postings = tokens.select("id", "len", F.explode("w").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = queries.select("q", F.explode(F.array_distinct(F.expr(words.format("text")))).alias("term"))
    met = terms.join(df, "term")  # no more rows than the queries have terms
    wanted = postings.join(F.broadcast(met) if is_small(terms) else met, "term").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n") + 1) / F.col("df"))
    part = idf * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg"))) + DELTA)
    scored = wanted.groupBy("q", "id").agg(F.round(F.sum(part), 9).alias("score"))
    return _top(scored.where("score > 0"), "q", "score", "id", k)


def bm25_names(queries: DataFrame, docs: DataFrame, k: int = 1000, name: str = "name") -> DataFrame:
    """(q, id, score, rank) over two indices of names, whole tokens and their parts: the better score of the two counts."""
    both = [bm25(queries, docs, k, name, words).select("q", "id", "score") for words in (RAW_WORDS, SPLIT_WORDS)]
    best = both[0].union(both[1]).groupBy("q", "id").agg(F.max("score").alias("score"))
    return _top(best, "q", "score", "id", k)


def unit(v: str) -> str:
    norm = f"sqrt(aggregate({v}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"
    return f"transform(array({norm}), m -> transform({v}, x -> if(m > 0, cast(x as double) / m, 0D)))[0]"  # bound once, not for each element


def vector_top(queries: DataFrame, docs: DataFrame, k: int = 1000) -> DataFrame:
    """(q, id, score, rank): exact inner products of queries (q, v) with docs (id, v).

    The stated queries go to all tasks in blocks of a fixed number; each task
    keeps the best of what it has read before anything is exchanged.
    """
    dot = "aggregate(zip_with(qv, v, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"
    found = []
    for block in dense_blocks(queries.select("q", F.col("v").alias("qv")), "q", QUERY_BLOCK):
        pairs = docs.crossJoin(F.broadcast(block)).select("q", "id", F.round(F.expr(dot), 9).alias("score"))
        found.append(_top(pairs, "q", "score", "id", k))
    return reduce(DataFrame.unionByName, found)


def hashed_words(df: DataFrame, text: str, name: str = "v") -> DataFrame:
    """Adds a deterministic embedding: counts of words by crc32 modulo 64, of unit length."""
    places = f"transform({WORDS.format(text)}, w -> cast(pmod(crc32(cast(w as binary)), {DIMENSIONS}) as int))"
    counts = f"if({text} is null, null, transform(array({places}), p -> transform(sequence(0, {DIMENSIONS - 1}), i -> cast(size(p) - size(array_remove(p, i)) as double)))[0])"
    return df.withColumn("_c", F.expr(counts)).withColumn(name, F.expr(unit("_c"))).drop("_c")


def fuse(*ranked: DataFrame, k: int = 500) -> DataFrame:
    """(q, id, score, rank): reciprocal-rank fusion of rankings (q, id, rank)."""
    every = ranked[0].select("q", "id", "rank")
    for r in ranked[1:]:
        every = every.union(r.select("q", "id", "rank"))
    return _top(every.groupBy("q", "id").agg(F.round(F.sum(1 / (F.col("rank") + RRF)), 12).alias("score")), "q", "score", "id", k)


def boost(pool: DataFrame, edges: DataFrame, weight: float = 0.1) -> DataFrame:
    """Raises candidates on which other candidates of the pool depend, edges (id, needs)."""
    needed = pool.join(edges, "id").select("q", F.col("needs").alias("id"), F.col("score").alias("by"))
    gain = needed.groupBy("q", "id").agg(F.max("by").alias("by"))
    out = pool.drop("rank").join(gain, ["q", "id"], "left").withColumn("score", F.col("score") + weight * F.coalesce("by", F.lit(0.0))).drop("by")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id")))


def package_filter(pool: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates whose package the query lists, (q, packages); queries that list none keep all. Ranks close up."""
    kept = pool.join(docs.select("id", "package"), "id").join(wanted, "q", "left").where("packages is null or size(packages) = 0 or array_contains(packages, package)")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).drop("package", "packages")


def cut(pool: DataFrame, k: int) -> DataFrame:
    return pool.where(F.col("rank") <= k)


def visible(pool: DataFrame, docs: DataFrame, pattern: str = AUTOGENERATED) -> DataFrame:
    """Candidates whose name is not one that was made by a program. Ranks close up."""
    named = pool.join(docs.select("id", "name"), "id").where(~F.col("name").rlike(pattern)).drop("name")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank")))


def rerank(pool: DataFrame, queries: DataFrame, docs: DataFrame, text: str = "text", mix: float = 0.0) -> DataFrame:
    """(q, id, score, rank) by the share of a query's words that a document holds, plus mix times the score that it came with; ties keep their order."""
    words = F.array_distinct
    q = queries.select("q", words(F.expr(WORDS.format("text"))).alias("qw"))
    d = docs.select("id", words(F.expr(WORDS.format(text))).alias("dw"))
    own = F.size(F.array_intersect("qw", "dw")) / F.greatest(F.size("qw"), F.lit(1))
    scored = pool.join(d, "id").join(q, "q").select("q", "id", F.col("rank").alias("before"), (F.round(own + F.lit(mix) * F.col("score"), 12) if mix else own).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "before"))).drop("before")


def fill_zero(lexical: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """A lexical ranking of k places in which documents without any query word follow, in the order of their ids.

    k of them for each query are enough, and at most k documents have a score.
    """
    found = []
    first = docs.select("id").orderBy("id").limit(2 * k)
    for block in dense_blocks(queries.select("q"), "q", QUERY_BLOCK):
        found.append(first.crossJoin(F.broadcast(block)))
    rest = reduce(DataFrame.unionByName, found).join(lexical.select("q", "id"), ["q", "id"], "left_anti").select("q", "id", F.lit(0.0).alias("score"))
    return _top(lexical.select("q", "id", "score").unionByName(rest), "q", "score", "id", k)


def lexical_audit(queries: DataFrame, docs: DataFrame, targets: DataFrame, k: int = 200) -> DataFrame:
    """(q, candidates, positive, zero, target_rank) of each query over targets (id): how far an unfiltered ranking is zeros."""
    ranked = fill_zero(bm25(queries, docs, k), queries, docs, k).join(targets.select("id", F.lit(True).alias("target")), "id", "left")
    return ranked.groupBy("q").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("score") > 0).alias("positive"), F.count_if(F.col("score") == 0).alias("zero"), F.min(F.when(F.col("target"), F.col("rank"))).cast("long").alias("target_rank"))


def resolve_targets(wanted: DataFrame, docs: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(q, name, id, found, missing) of wanted (q, name): the document of that name, within the packages that the query lists (q, packages), if any."""
    met = wanted.join(docs.select("id", "name", *(["package"] if packages is not None else [])), "name", "left")
    if packages is not None:
        met = met.join(packages.select("q", "packages"), "q", "left")
        outside = "packages is not null and size(packages) > 0 and not coalesce(array_contains(packages, package), false)"
        met = met.withColumn("id", F.expr(f"if({outside}, null, id)"))
    return met.groupBy("q", "name").agg(F.min("id").alias("id"), F.count("id").alias("found"), (F.count("id") == 0).alias("missing"))


def check_targets(resolved: DataFrame) -> None:
    """Raise if a target has no document, or none that the query's packages let through."""
    lost = resolved.where("missing").orderBy("q", "name").limit(20).collect()
    if lost:
        raise ValueError("targets without a document: " + ", ".join(f"{r['name']} of {r['q']}" for r in lost))


def variant_grid(queries: DataFrame, depths=(0, 50, 100), zeros=(True, False), boosts=(True, False)) -> DataFrame:
    """(q, depth, exclude_zero, boost): each query under each variant; the grid is a few rows."""
    grid = queries.sparkSession.createDataFrame([(d, z, b) for d in depths for z in zeros for b in boosts], "depth int, exclude_zero boolean, boost boolean")
    return queries.select("q").crossJoin(F.broadcast(grid))


STAGES = ("bm25_raw", "bm25", "semantic", "fusion", "selection", "package_filter", "reranker_input", "reranked", "results")


def stages(queries: DataFrame, docs: DataFrame, depth: int, limit: int, pool: int = 500, candidates: int = 1000, exclude_zero: bool = True, edges: DataFrame | None = None, mix: float = 0.0, semantic: DataFrame | None = None, timed: bool = False):
    """(q, stage, id, rank): the trace of a search through all stages. docs: id, text, package, and name, without which none is left out; queries: q, text, packages.

    A query without a word finds nothing. semantic is a ranking by a model, if
    there is one; else hashed words stand in. With timed each stage is written
    before the next, and the result is (trace, {stage: milliseconds since the start}).
    """
    began, took, kept = time.monotonic(), {}, {}
    asked = queries.where(F.length(F.trim("text")) > 0)

    def done(name: str, df: DataFrame) -> DataFrame:
        kept[name] = materialize(df, name) if timed else df
        took[name] = 1000 * (time.monotonic() - began)
        return kept[name]

    scored = bm25(asked, docs, candidates)
    raw = done("bm25_raw", fill_zero(scored, asked, docs, candidates))
    lexical = done("bm25", scored if exclude_zero else raw)
    semantic = done("semantic", semantic if semantic is not None else vector_top(hashed_words(asked, "text"), hashed_words(docs, "text"), candidates))
    fused = done("fusion", fuse(lexical, semantic, k=pool))
    selected = done("selection", boost(fused, edges) if edges is not None else fused)
    filtered = done("package_filter", package_filter(selected, docs, asked.select("q", "packages")))
    given = done("reranker_input", cut(filtered, depth if depth else limit))
    ranked = done("reranked", rerank(given, asked, docs, mix=mix))
    done("results", cut(visible(ranked, docs) if "name" in docs.columns else ranked, limit))
    trace = reduce(DataFrame.unionByName, (kept[n].select("q", F.lit(n).alias("stage"), "id", F.col("rank").cast("long").alias("rank")) for n in STAGES))
    return (trace, took) if timed else trace


def run_experiment(queries: DataFrame, docs: DataFrame, relevant: DataFrame, variants: list[dict], repetitions: int = 1, edges: DataFrame | None = None, limit: int = 10, seed: int = 42) -> DataFrame:
    """Records (variant, repetition, place, q, stage, k, hit, recall, mrr, ndcg, first_rank, elapsed_ms) of every stage under every variant.

    variants: a few dicts of depth, exclude_zero and boost. A variant's searches
    run as one batch, so elapsed_ms is of the batch up to that stage; place is
    where the case stands in its repetition's shuffled order.
    """
    spark, out = queries.sparkSession, []
    names = [f"depth={v['depth']},exclude_zero={v['exclude_zero']},boost={v['boost']}" for v in variants]
    cases = queries.select("q").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "variant string")))
    order = sampling.run_order(cases, ["q", "variant"], repetitions, seed)
    for repetition in range(repetitions):
        for name, v in zip(names, variants, strict=True):
            trace, took = stages(queries, docs, v["depth"], limit, exclude_zero=v["exclude_zero"], edges=edges if v["boost"] else None, timed=True)
            times = spark.createDataFrame(list(took.items()), "stage string, elapsed_ms double")
            scored = ranking.stage_metrics(trace, relevant).join(F.broadcast(times), "stage")
            out.append(materialize(scored.withColumns({"variant": F.lit(name), "repetition": F.lit(repetition)}), "records"))
    every = reduce(DataFrame.unionByName, out)
    return every.join(order, ["q", "variant", "repetition"])
