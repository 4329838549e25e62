"""Relevance collections, ranked runs and pilot queries in JSON: readers and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTION = "corpus_revision string, queries array<struct<id string, group_id string, track string, answerability string, judgments map<string, int>, premise_routes array<array<array<string>>>>>"
RUN = "name string, corpus_revision string, max_k int, results map<string, struct<status string, documents array<string>, latency_ms double, cost_usd double, abstained boolean>>"
PILOT = "id string, query string, category string, relevant array<string>, packages array<string>"


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, qrels, routes) in long form."""
    q = spark.read.schema(COLLECTION).json(path, multiLine=True).select("corpus_revision", F.explode("queries").alias("x")).select("corpus_revision", "x.*")
    queries = q.select("corpus_revision", F.col("id").alias("q"), "group_id", "track", "answerability")
    qrels = q.select(F.col("id").alias("q"), F.explode("judgments").alias("doc", "grade"))
    routes = q.select(F.col("id").alias("q"), F.posexplode("premise_routes").alias("route", "r")).select("q", "route", F.posexplode("r").alias("grp", "g")).select("q", "route", "grp", F.explode("g").alias("doc"))
    return queries, qrels, routes


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, ranking): name, corpus_revision, max_k, q, status, latency_ms, cost_usd, abstained; q, doc, rank."""
    r = spark.read.schema(RUN).json(path, multiLine=True).select("name", "corpus_revision", "max_k", F.explode("results").alias("q", "x")).select("name", "corpus_revision", "max_k", "q", "x.*")
    ranking = r.select("q", F.posexplode("documents").alias("p", "doc")).select("q", "doc", (F.col("p") + 1).cast("long").alias("rank"))
    return r.drop("documents"), ranking


def scheduled(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Every query with the outcome of its request; a request that is missing has a null status."""
    return queries.drop("corpus_revision").join(results.select("q", "status", "abstained", "latency_ms", "cost_usd"), "q", "left")


def problems(queries: DataFrame, qrels: DataFrame, routes: DataFrame, results: DataFrame, ranking: DataFrame) -> DataFrame:
    """(rule, violations) beyond those of ranking.violations: revisions, depth, failures with documents, routes."""
    depth = ranking.groupBy("q").agg(F.max("rank").alias("deepest"), F.count_if(F.expr("doc is null or doc = ''")).alias("empty"))
    r = results.join(depth, "q", "left").join(queries.select("q", F.col("corpus_revision").alias("pinned")), "q", "left")
    out = r.agg(
        F.count_if(F.expr("pinned is not null and (corpus_revision is null or corpus_revision = '' or corpus_revision <> pinned)")).alias("corpus revisions differ"),
        F.count_if(F.expr("max_k is null or max_k < 1")).alias("max_k is not positive"), F.count_if(F.expr("deepest > max_k")).alias("result deeper than max_k"),
        F.count_if(F.expr("status <> 'ok' and deepest > 0")).alias("failed request with documents"), F.count_if(F.expr("abstained and deepest > 0")).alias("abstained with documents"),
        F.count_if(F.expr("empty > 0")).alias("empty document id"),
    )
    long = out.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in out.columns))).alias("x")).select("x.*")
    bad_routes = routes.join(qrels, ["q", "doc"], "left").where("coalesce(grade, 0) < 2").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("route through a document that is not relevant").alias("rule"), "violations")
    tracks = queries.agg(F.count_if(~F.col("track").isin("human", "agent", "unknown")).alias("violations")).select(F.lit("unknown track").alias("rule"), "violations")
    return long.unionByName(bad_routes).unionByName(tracks)


def pilot_problems(pilot: DataFrame) -> DataFrame:
    """(rule, violations) of pilot queries."""
    one = pilot.agg(
        F.count_if(F.expr("coalesce(trim(id), '') = '' or coalesce(trim(query), '') = '' or coalesce(trim(category), '') = ''")).alias("empty id, query or category"),
        F.count_if(F.expr("relevant is null or size(relevant) = 0 or exists(relevant, x -> coalesce(trim(x), '') = '')")).alias("no relevant names"),
        F.count_if(F.expr("size(relevant) <> size(array_distinct(relevant))")).alias("repeated relevant names"), F.count_if(F.expr("exists(packages, x -> x is null)")).alias("null package"),
        (F.count("id") - F.countDistinct("id")).alias("repeated id"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("no queries"),
    )
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in one.columns))).alias("x")).select("x.*")


def read_pilot(spark: SparkSession, path: str) -> DataFrame:
    pilot = spark.read.schema(PILOT).json(path, multiLine=True)
    broken = pilot_problems(pilot).where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))
    return pilot
