"""What evaluations, categories, experiments, settings and servers must keep."""

import json
import random
import threading
import urllib.error
import urllib.parse
import urllib.request
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylens.functions import text
from querylens.operators import clusters, groups, inference, ranking, report, retrieval, sampling
from querylens.operators.components import connected_components
from querylens.sources import files, server, settings


def test_comparisons_are_refused(spark):
    c = spark.createDataFrame([(i, "human", f"g{i}", "answerable") for i in range(4)], "q long, track string, group_id string, answerability string")
    j = spark.createDataFrame([(i, "d", 2) for i in range(4)], "q long, doc string, grade int")
    inference.check_comparable(c, c, j, j, ("r", "r"))
    for other in ((c.where("q > 0"), j, ("r", "r")), (c.withColumn("track", F.lit("agent")), j, ("r", "r")), (c, j.withColumn("grade", F.lit(3)), ("r", "r")), (c, j.where("q > 0"), ("r", "r")), (c, j, ("r", "s"))):
        with pytest.raises(ValueError):
            inference.check_comparable(c, other[0], j, other[1], other[2])
    a = spark.createDataFrame([(i, "ndcg@5", 0.5) for i in range(4)], "q long, metric string, value double")
    with pytest.raises(ValueError):
        inference.paired(c, a, a.where("q > 0"), "ndcg@5")
    assert inference.paired(c, a, a, "ndcg@5", "agent").count() == 0


def test_routes_are_scored_and_deep_cutoffs_reported(spark):
    c = spark.createDataFrame([(1, "g", "human", "answerable", "ok", False, 1.0, None)], "q long, group_id string, track string, answerability string, status string, abstained boolean, latency_ms double, cost_usd double")
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q long, doc string, rank long")
    qrels = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "c", 2)], "q long, doc string, grade int")
    routes = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "c"), (1, 1, 0, "b")], "q long, route int, grp int, doc string")
    got = {r["metric"]: r["value"] for r in ranking.query_scores(c, run, qrels, (1, 2, 50), 2, routes).collect()}
    assert got["best_route_group_recall@1"] == 0.5 and got["route_covered@1"] == 0 and got["route_covered@2"] == 1
    assert ranking.unavailable((1, 2, 50), 2) == [50] and not any(m.endswith("@50") for m in got)


def test_small_bootstrap_draws_as_many_groups_as_there_are(spark):
    rng = random.Random(2)
    rows = [(g, rng.uniform(-1, 2), 1 + g % 3) for g in range(12)]
    got = inference.bootstrap_interval(spark.createDataFrame(rows, "group_id long, s double, n long"), 4000).first()
    draws = []
    for _ in range(20000):
        some = rng.choices(rows, k=12)
        draws.append(sum(s for _, s, _ in some) / sum(n for _, _, n in some))
    assert got["low"] == pytest.approx(np.percentile(draws, 2.5), abs=0.04) and got["high"] == pytest.approx(np.percentile(draws, 97.5), abs=0.04)


def test_skeleton_components_against_a_dense_decomposition(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["W", "of", "ID", "the", "NUM", "="], k=rng.randint(1, 8)))) for i in range(120)]
    weights = clusters.skeleton_weights(spark.createDataFrame(rows, "id long, skeleton string"), "id")
    w = weights.toPandas()
    grams, ids = sorted(set(w.gram)), sorted(set(w.id))
    dense = np.zeros((len(ids), len(grams)))
    for r in w.itertuples():
        dense[ids.index(r.id), grams.index(r.gram)] = r.weight
    assert np.allclose((dense**2).sum(axis=1), 1)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    got = {r["id"]: r["components"] for r in clusters.skeleton_components(weights, "id", 5).collect()}
    mine = np.array([got[i] for i in ids])
    for j in range(5):
        want = dense @ vt[j]
        assert min(np.abs(mine[:, j] - want).max(), np.abs(mine[:, j] + want).max()) < 1e-6
    one = clusters.skeleton_weights(spark.createDataFrame([(1, "W"), (2, "W")], "id long, skeleton string"), "id")
    assert clusters.skeleton_components(one, "id").count() == 0


def styled(spark, n=300):
    """Points of two clear styles."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 0.3 + (0 if i % 3 else 4)]) for i in range(n)]
    from pyspark.ml.functions import array_to_vector

    return spark.createDataFrame(rows, "id long, v array<double>").select("id", array_to_vector("v").alias("features"))


def test_stable_classes_are_found(spark):
    df = styled(spark).cache()
    labels, table = clusters.select_classes(df, "id", most=3, rounds=1)
    rows = {r["categories"]: r for r in table.collect()}
    assert rows[2]["min_jaccard"] >= 0.95 and rows[2]["ari"] >= 0.95 and all(np.isfinite(r["bic"]) for r in rows.values())
    if rows[3]["min_jaccard"] < 0.75:
        got = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert sorted(got.values()) == [100, 200]
    paths, selection = clusters.fit_categories(df, "id", most=2, rounds=1)
    assert paths.count() == 300 and {r["category"].split(".")[0] for r in paths.collect()} == {"1", "2"} and {r["level"] for r in selection.collect()} >= {"top"}


def test_prepare_fits_categories(spark):
    log = spark.createDataFrame([(i, f"query {i}", [], "web", 1, "2024-01-01") for i in range(12)], "row_id long, query string, packages array<string>, source string, result_count int, collected_on string")
    rows, one = groups.prepare(log, 1.0, fit=True)
    assert {r["category"] for r in one.collect()} == {"1"} and rows.count() == 12  # too few to be split


def test_samples_have_fixed_sizes(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    for n in (0, 1, 77, 4999, 5000, 9000):
        got = [r["k"] for r in sampling.hash_sample(df, "k", n).collect()]
        assert len(got) == len(set(got)) == min(n, 5000)
    a, b = (sorted(r["k"] for r in sampling.hash_sample(df.repartition(p), "k", 100).collect()) for p in (1, 7))
    assert a == b != sorted(r["k"] for r in sampling.hash_sample(df, "k", 100, seed=1).collect())
    per = sampling.group_sample(df.withColumn("g", F.expr("k % 3")), ["g"], "k", 4).groupBy("g").count().collect()
    assert [r["count"] for r in per] == [4, 4, 4]


def test_hashed_words_against_a_plain_count(spark):
    rows = [(i, t) for i, t in enumerate(["red ring", "Red RED widget 7", "", "a b c d e f g"])]
    got = retrieval.hashed_words(spark.createDataFrame(rows, "id long, text string"), "text").collect()
    for r in got:
        want = np.zeros(64)
        import re

        for w in re.findall("[a-z0-9]+", r["text"].lower()):
            want[zlib.crc32(w.encode()) % 64] += 1
        norm = np.linalg.norm(want)
        assert np.allclose(r["v"], want / norm if norm else want)


def fixture_engine(spark):
    docs = spark.createDataFrame([(1, "Ring.add", "ring add", "core"), (2, "Ring.mul", "ring mul", "core"), (3, "proof_12", "ring proof", "core"), (4, "Field.inv", "field inverse", "extra"), (5, "List.map", "list map", "extra")], "id long, name string, text string, package string")
    queries = spark.createDataFrame([(1, "ring add", []), (2, "field", ["extra"]), (3, "  ", [])], "q long, text string, packages array<string>")
    return queries, docs


def test_stages_of_a_search(spark):
    queries, docs = fixture_engine(spark)
    trace, took = retrieval.stages(queries, docs, depth=3, limit=2, exclude_zero=False, edges=spark.createDataFrame([(1, 2)], "id long, needs long"), timed=True)
    got = {}
    for r in trace.orderBy("q", "stage", "rank").collect():
        got.setdefault((r["q"], r["stage"]), []).append(r["id"])
    assert set(took) == set(retrieval.STAGES) and list(took.values()) == sorted(took.values())
    assert not any(q == 3 for q, _ in got)  # a query without a word finds nothing
    assert got[1, "bm25_raw"][0] == 1 and len(got[1, "bm25_raw"]) == 5 and 3 not in got[1, "results"] and len(got[1, "results"]) <= 2
    assert got[2, "package_filter"] and set(got[2, "package_filter"]) <= {4, 5}
    assert len(got[1, "reranker_input"]) == 3
    without = retrieval.stages(queries, docs, depth=3, limit=2).where("stage = 'bm25'")
    assert {r["id"] for r in without.where("q = 2").collect()} == {4}


def test_experiment_runs_every_variant(spark, tmp_path):
    queries, docs = fixture_engine(spark)
    relevant = spark.createDataFrame([(1, 1), (2, 4)], "q long, doc long")
    variants = [{"depth": 3, "exclude_zero": True, "boost": False}, {"depth": 0, "exclude_zero": False, "boost": True}]
    records = retrieval.run_experiment(queries, docs, relevant, variants, repetitions=2, edges=spark.createDataFrame([(1, 2)], "id long, needs long"), limit=2).cache()
    rows = records.collect()
    assert {r["variant"] for r in rows} == {"depth=3,exclude_zero=True,boost=False", "depth=0,exclude_zero=False,boost=True"} and {r["repetition"] for r in rows} == {0, 1}
    assert all(r["hit"] == 1 and r["mrr"] == 1 for r in rows if r["stage"] == "reranked" and r["q"] == 1)
    path = f"{tmp_path}/report.json"
    summary = records.where("stage = 'results'").groupBy("variant").agg(F.avg("hit").alias("hit"))
    files.experiment_report(spark, records.select("variant", "q", "stage", "hit"), summary, path, depth=3)
    assert json.load(open(path))["schema_version"] == 1
    with pytest.raises(FileExistsError):
        files.experiment_report(spark, records, summary, path)


def test_targets_without_a_document_are_refused(spark):
    queries, docs = fixture_engine(spark)
    wanted = spark.createDataFrame([(1, "Ring.add"), (2, "Ring.add")], "q long, name string")
    retrieval.check_targets(retrieval.resolve_targets(wanted, docs))
    with pytest.raises(ValueError, match="Ring.add of 2"):
        retrieval.check_targets(retrieval.resolve_targets(wanted, docs, queries.select("q", "packages")))


def test_case_folding(spark):
    got = groups.with_normal_form(spark.createDataFrame([("Straße  ΑΣ",), ("ABC -> d",)], "query string"), folded=True).collect()
    assert [r["normalized"] for r in got] == ["Straße ΑΣ".casefold(), "abc → d"]


def test_settings(spark, tmp_path, monkeypatch):
    f = tmp_path / "env"
    f.write_text("# all\nexport A='x # y' # z\nB=\"open\nC = plain # note\nD=a#b\nnothing\nA=last\n")
    assert settings.read_settings(spark, f"file://{f}") == {"A": "last", "B": "open", "C": "plain", "D": "a#b"}
    monkeypatch.setenv("C", "outside")
    assert settings.resolved(spark, "C", f"file://{f}") == "outside" and settings.resolved(spark, "D", f"file://{f}") == "a#b"
    with pytest.raises(KeyError):
        settings.resolved(spark, "NONE", f"file://{f}")
    assert settings.database_path("p") == "p" and settings.database_path(None, "d") == "d"


def served(s):
    threading.Thread(target=s.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{s.server_address[1]}"


def test_page_server():
    with server.page_server("<p>all</p>") as s:
        url = served(s)
        with urllib.request.urlopen(url + "/index.html") as r:
            assert r.read() == b"<p>all</p>" and r.headers["Cache-Control"] == "no-store"
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(url + "/other")
        s.shutdown()


def test_review_server(tmp_path):
    out = tmp_path / "labels.json"
    sample = [{"position": 4, "text": "<b>q", "population": 9, "sampled": 1}]
    good = {"intent": "find_lemma", "actor": "unknown", "certainty": "clear", "evidence": "annotator_inference", "language": "english", "expected_output": "proof"}
    with server.review_server(sample, {"reviewer": "r"}, str(out)) as s:
        url = served(s)
        page = urllib.request.urlopen(url).read().decode()
        token = page.split("name='token' value='")[1].split("'")[0]

        def post(**form):
            return urllib.request.urlopen(url, urllib.parse.urlencode(form).encode()).read().decode()

        assert "&lt;b&gt;q" in page
        for bad in ({"token": "x", "position": 4, **good}, {"token": token, "position": 5, **good}, {"token": token, "position": 4, **good, "language": "de"}, {"token": token, "position": 4, **good, "actor": "human_confirmed"}):
            with pytest.raises(urllib.error.HTTPError):
                post(**bad)
        assert "complete" in post(token=token, position=4, **good)
        s.shutdown()
    assert json.loads(out.read_text())["annotations"]["4"]["population"] == 9
    with pytest.raises(ValueError):
        server.review_server(sample, {"reviewer": "other"}, str(out))


def test_publication_rules(tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.txt"
    a.write_text("x")
    b.write_text("y")
    import hashlib

    rules = {"*/a.csv": hashlib.sha256(b"x").hexdigest()}
    assert files.problems_of_publication([str(a)], rules) == []
    assert len(files.problems_of_publication([str(a), str(b)], rules)) == 1
    a.write_text("z")
    assert files.problems_of_publication([str(a)], rules) == [f"changed: {a}"]


def test_cells_of_a_page():
    assert [files.cell(x) for x in (None, 0.1234, 12345, True, "a")] == ["", "12.34%", "12,345", "true", "a"]


def test_usage_of_nothing(spark):
    r = report.usage_totals(spark.createDataFrame([], "prompt_tokens long, completion_tokens long, cost double")).first()
    assert tuple(r) == (0, 0, 0, 0.0)


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(clusters, "RANKED_VALUES", 7)
    rng = random.Random(5)
    x = [float(rng.randrange(40)) for _ in range(300)]
    got = {r["i"]: r["rank_x"] for r in clusters.average_ranks(spark.createDataFrame(list(enumerate(x)), "i int, x double"), ["x"]).collect()}
    order = sorted(x)
    assert all(got[i] == order.index(v) + (order.count(v) + 1) / 2 for i, v in enumerate(x))


def test_a_hub_is_one_component(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 50)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert got.count() == 2999 + 49 and {r["component"] for r in got.collect()} == {0}


def test_dimensions_of_a_null_text(spark):
    row = text.with_dimensions(spark.createDataFrame([(None, None)], "x string, p array<string>"), "x", "p").first()
    assert row["words"] is not None and row["surface"] is not None
