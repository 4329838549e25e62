import itertools
import random

import pytest
from pyspark.sql import functions as F

from querylens.operators import clusters, components, gate, groups, inference, ranking, retrieval, sampling, workload
from querylens.sources import log


def cells(spark, counts):
    return spark.createDataFrame([(k, i) for k, n in counts.items() for i in range(n)], "k string, i int")


def as_dict(df):
    return {r["k"]: r["n"] for r in df.collect()}


def test_log_gate(spark):
    assert as_dict(gate.releasable_counts(cells(spark, {"a": 20, "b": 12}), ["k"])) == {"a": 20, "b": 10}
    assert as_dict(gate.releasable_counts(cells(spark, {"a": 20, "b": 15, "c": 3}), ["k"])) == {"a": 20, gate.SUPPRESSED: 20}
    assert as_dict(gate.releasable_counts(cells(spark, {"a": 20, "b": 2, "c": 1}), ["k"])) == {"a": 20, gate.SUPPRESSED: None}
    assert as_dict(gate.releasable_counts(cells(spark, {"a": 20, "b": 3}), ["k"])) == {"a": 20, gate.SUPPRESSED: None}
    with pytest.raises(ValueError):
        gate.releasable_counts(cells(spark, {"a": 1}).withColumnRenamed("k", "query"), ["query"])


def test_export_gate(spark):
    c = spark.createDataFrame([("t", "s", "a", 20), ("t", "s", "b", 3), ("u", "s", "a", 20)], "v string, source string, category string, n long")
    got = {(r["v"], r["category"]): r["count"] for r in gate.release(c, ["v"]).collect()}
    assert got == {("t", "suppressed"): 20, ("u", "a"): 20}
    with pytest.raises(ValueError):
        gate.release(c, ["v"], 5)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {x: find(x) for x in list(root) if find(x) != x}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_is_exact(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += [t + "a" for t in texts[:20]] + ["abc", "abd"]
    texts = list(dict.fromkeys(texts))
    rows = [(i, i % 2, t) for i, t in enumerate(texts)]
    got = {(r["a"], r["b"]): r["similarity"] for r in groups.similar_pairs(spark.createDataFrame(rows, "id long, blk int, normalized string"), ["blk"], 0.5).collect()}

    def grams(t):
        return {t} if len(t) <= 4 else {t[i : i + 4] for i in range(len(t) - 3)}

    want = {}
    for (i, bi, a), (j, bj, b) in itertools.combinations(rows, 2):
        s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        if bi == bj and s >= 0.5:
            want[i, j] = s
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_groups_bridge_days(spark):
    long = "a rather long query about sums over finite sets"
    rows = [(1, long, "web", "1"), (2, long, "api", "2"), (3, long + " x", "api", "2"), (4, "unrelated text of another kind", "web", "1"), (5, long + " x", "mcp", "9")]
    got = {r["row_id"]: r["group_id"] for r in groups.assign_groups(spark.createDataFrame(rows, "row_id long, query string, source string, collected_on string"), 0.9).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}
    exact = {r["row_id"]: r["group_id"] for r in groups.assign_groups(spark.createDataFrame(rows, "row_id long, query string, source string, collected_on string"), 1.0).collect()}
    assert exact == {1: 0, 2: 0, 3: 1, 4: 2, 5: 1}


def test_ranking(spark):
    run = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (1, "b", 3), (2, "a", 1), (2, "a", 2), (2, "b", 3)], "q long, doc string, rank long")
    qrels = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "z", 0), (2, "a", 3), (2, "b", 2), (3, "a", 2)], "q long, doc string, grade int")
    got = {(r["q"], r["k"]): r for r in ranking.ranking_metrics(run, qrels, (2, 3)).collect()}
    r = got[1, 3]
    assert r["recall"] == 1 and r["mrr"] == 0.5 and r["map"] == pytest.approx((0.5 + 2 / 3) / 2) and r["judged"] == 1
    assert got[2, 2]["recall"] == 0.5 and got[2, 2]["judged"] == 0.5
    assert got[3, 3]["ndcg"] == 0 and got[3, 3]["judged"] == 0
    with pytest.raises(ValueError):
        ranking.ranking_metrics(run, qrels, (0,))


def test_routes_do_not_mix(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "d", 2)], "q long, doc string, rank long")
    routes = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, "d")], "q long, route int, grp int, doc string")
    r = ranking.premise_metrics(run, routes, (2,)).first()
    assert r["best_route_group_recall"] == 0.5 and r["route_covered"] == 0


def test_inference(spark):
    same = spark.createDataFrame([(g, 0.0, 2) for g in range(5)], "group_id long, s double, n long")
    assert inference.effect(same).first()["candidate_minus_baseline"] == 0
    assert tuple(inference.bootstrap_interval(same, 200).first()) == (0.0, 0.0)
    assert inference.sign_randomization(same, 200).first()["p"] == 1
    some = spark.createDataFrame([(g, 1.0 + g / 10, 1) for g in range(10)], "group_id long, s double, n long")
    assert inference.exact_sign_p(some) == 2 / 2**10
    assert inference.sign_randomization(some, 4000).first()["p"] < 0.01
    low, high = inference.bootstrap_interval(some, 2000).first()
    assert 1.2 < low < 1.45 < high < 1.7
    p = spark.createDataFrame([(0, 0.04), (1, 0.001), (2, 0.03)], "id int, p double")
    assert [r["adjusted"] for r in inference.holm(p).orderBy("id").collect()] == pytest.approx([0.06, 0.003, 0.06])
    with pytest.raises(ValueError):
        inference.holm(spark.createDataFrame([(0, 1.5)], "id int, p double"))


def test_quotas_go_round(spark):
    rng = random.Random(1)
    for size in (1, 7, 40, 500):
        strata = [(f"s{rng.randrange(5)}", f"k{i}", rng.randint(1, 20)) for i in range(12)]
        got = {(r["source"], r["surface"]): r["quota"] for r in sampling.quotas(spark.createDataFrame(strata, "source string, surface string, n long"), ["source", "surface"], size).collect()}
        want, left = dict.fromkeys(sorted((a, b) for a, b, _ in strata), 0), size
        most = {(a, b): n for a, b, n in strata}
        while left and any(want[k] < most[k] for k in want):
            for k in want:
                if left and want[k] < most[k]:
                    want[k] += 1
                    left -= 1
        assert got == want


def test_label_errors(spark):
    good = {"intent": "find_lemma", "actor": "unknown", "certainty": "clear", "evidence": "annotator_inference", "language": "english", "expected_output": "proof"}
    rows = [good, good | {"language": "xx", "actor": "human_confirmed"}, good | {"certainty": None, "actor": "agent_confirmed", "evidence": "client_attestation"}, good | {"evidence": None}]
    a = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows, 1)], "position int, " + ", ".join(f"{n} string" for n in good))
    assert {(r["position"], r["error"]) for r in sampling.label_errors(a).collect()} == {(2, "unknown language"), (2, "actor without evidence"), (3, "unknown certainty"), (4, "unknown evidence")}


def test_workload_is_independent_of_order(spark):
    rows = [(i, "api" if i % 3 else "web", f"q {i % 30}", [], i % 4 or None, "2024-01-01" if i % 2 else "2024-01-02") for i in range(150)]
    schema = "position long, source string, text string, packages array<string>, result_count long, day string"
    df = spark.createDataFrame(rows, schema).withColumn("day", F.col("day").cast("date"))
    a = sorted(map(str, workload.workload(df).collect()))
    assert a == sorted(map(str, workload.workload(df.orderBy(F.desc("position"))).collect()))


def test_agreement(spark):
    d = spark.createDataFrame([(i, i % 3, (i + 1) % 3) for i in range(30)], "id int, a int, b int")
    assert clusters.rand_index(d, "a", "b").first()[0] == 1
    assert all(r["jaccard"] == 1 for r in clusters.best_jaccard(d, "a", "b").collect())
    r = {(x["x"], x["y"]): x["r"] for x in clusters.correlations(spark.createDataFrame([(i, -i, i * i) for i in range(10)], "a int, b int, c int"), ["a", "b", "c"]).collect()}
    assert r["a", "b"] == pytest.approx(-1) and r["a", "c"] == pytest.approx(1) and r["b", "a"] == r["a", "b"]


def test_stages(spark):
    docs = spark.createDataFrame([(1, "red ring", "p"), (2, "blue bolt", "q"), (3, "red bolt", "p"), (4, "green", "q")], "id long, text string, package string")
    q = spark.createDataFrame([(1, "red bolt", ["p"]), (2, "", [])], "q long, text string, packages array<string>")
    got = {}
    for r in retrieval.stages(q, docs, depth=3, limit=2).orderBy("rank").collect():
        got.setdefault((r["q"], r["stage"]), []).append(r["id"])
    assert got[1, "bm25"][0] == 3 and 4 not in got[1, "bm25"]
    assert set(got[1, "package_filter"]) == {1, 3} and got[1, "results"][0] == 3
    assert (2, "bm25") not in got
    more = retrieval.stages(q, docs, depth=3, limit=2, exclude_zero=False).where("q = 1 and stage = 'bm25'").count()
    assert more == 4


def test_tokens_and_payloads(spark):
    key = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="
    other = "YWJjZGVmMDEyMzQ1Njc4OTAxMjM0NTY3ODlhYmNkZWY="
    df = spark.createDataFrame([('{"q": "x", "pkg": ["a"]}',), ("[1]",), ('{"q": 7}',), ('{"q": "y", "pkg": null}',), ("not json",)], "p string").withColumn("t", log.encrypted("p", key, "unhex('000102030405060708090a0b0c0d0e0f')"))
    got = [r[0] for r in df.select(log.decrypted("t", key).alias("d")).select(log.parsed("d")).collect()]
    assert [g and (g["q"], g["pkg"]) for g in got] == [("x", ["a"]), None, None, ("y", []), None]
    assert df.select(log.decrypted("t", other)).distinct().first()[0] is None
    assert df.select(log.decrypted("p", key)).distinct().first()[0] is None


def test_kendall(spark):
    d = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 4), (4, 5), (5, 5)], "a int, b int")
    pairs = list(itertools.combinations([tuple(r) for r in d.collect()], 2))
    sign = [((p[0] > q[0]) - (p[0] < q[0])) * ((p[1] > q[1]) - (p[1] < q[1])) for p, q in pairs]
    tied = [sum(p[i] == q[i] for p, q in pairs) for i in (0, 1)]
    want = sum(sign) / ((len(pairs) - tied[0]) * (len(pairs) - tied[1])) ** 0.5
    assert clusters.kendall(d, "a", "b").first()["tau"] == pytest.approx(want)


def test_prepare(spark):
    rows = [(i, f"Nat.add_{i % 30}", ["p"] if i % 2 else [], "web" if i % 3 else "api", i % 4, "2024-01-01") for i in range(90)]
    log_ = spark.createDataFrame(rows, "row_id long, query string, packages array<string>, source string, result_count long, collected_on string")
    rows_, one = groups.prepare(log_, threshold=1.0)
    assert rows_.count() == 90 and one.count() == 30 and rows_.where("in_repeated_group").count() == 90
    assert {r["skeleton"] for r in one.collect()} == {"ID"} and {r["repeat_bin"] for r in one.collect()} == {"3–5"}


def test_few_queries_are_one_category(spark):
    d = spark.createDataFrame([(i,) for i in range(10)], "id int")
    paths, selection = clusters.fit_categories(d, "id")
    assert {r["category"] for r in paths.collect()} == {"1"} and selection.count() == 0


def test_groups_default_to_the_references_threshold(spark):
    a = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(1, a, [], "web", 1, "2024-01-01"), (2, a + "!?#$", [], "web", 1, "2024-01-01"), (3, a + "=+<>;:&%@()", [], "web", 1, "2024-01-01")]  # similarities 33/37 and 33/44
    log_ = spark.createDataFrame(rows, "row_id long, query string, packages array<string>, source string, result_count long, collected_on string")
    assert {r["row_id"]: r["group_id"] for r in groups.assign_groups(log_).collect()} == {1: 0, 2: 0, 3: 1}
    assert sorted(r["n_rows"] for r in groups.prepare(log_)[1].collect()) == [1, 2]


def test_unit_vectors_bind_their_norm_once(spark):
    """The norm is a sum over the whole vector; it stands outside of what runs for each element."""
    from querylens.operators import retrieval

    e = retrieval.unit("v")
    assert e.count("sqrt(") == 1 and e.index("sqrt(") < e.index("transform(v")
    got = retrieval.hashed_words(spark.createDataFrame([("red Red widget",), ("",), (None,)], "text string"), "text").select("v").collect()
    assert sorted(x for x in got[0][0] if x) == [1 / 5**0.5, 2 / 5**0.5] and got[1][0] == [0.0] * 64 and got[2][0] is None
