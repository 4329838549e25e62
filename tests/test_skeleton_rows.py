"""Skeletons' sparse rows: worked out once, weighed row by row, reduced as they are."""

import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from querylens.operators import clusters


def test_skeletons_are_worked_out_once(spark):
    rng, met = random.Random(1), spark.sparkContext.accumulator(0)

    def marked(s):
        met.add(1)
        return s

    rows = [(i, " ".join(rng.choices(["W", "of", "ID", "the", "NUM", "=", "(", ")"], k=rng.randint(6, 20)))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, skeleton string").select("id", F.udf(marked, StringType())("skeleton").alias("skeleton"))
    weights = clusters.skeleton_weights(df, "id")
    assert weights.select("gram").distinct().count() > 100  # more than what is decomposed on the driver at once
    assert clusters.skeleton_components(weights, "id", 3).count() == 90
    assert met.value == 90


def test_rows_and_components_of_odd_skeletons(spark):
    rng = random.Random(2)
    rows = [(f"k{i}", " ".join(rng.choices(["W", "of", "ID", "the", "NUM", "=", "(", ")"], k=rng.randint(6, 16)))) for i in range(150)]
    odd = [("null", None), ("empty", ""), ("rare", "never met"), ("gaps", "  W   of "), (None, "W W W")]
    sparse, grams = clusters.skeleton_rows(spark.createDataFrame(rows + odd, "name string, skeleton string"), "name")
    got = {r["name"]: (r["i"], r["weight"]) for r in sparse.collect()}
    assert len(grams) > 100 and grams == sorted(grams)
    assert set(got) == {k for k, _ in rows} | {"gaps", None}
    lists = {k: [g for n in (1, 2, 3) for g in (" ".join(t[j : j + n]) for j in range(len(t) - n + 1))] for k, t in ((k, [x for x in (s or "").split(" ") if x]) for k, s in rows + odd)}
    met = {g: sum(g in x for x in lists.values()) for g in grams}
    assert min(met.values()) >= 5 and sum(sum(g in x for x in lists.values()) >= 5 for g in {g for x in lists.values() for g in x}) == len(grams)
    dense = np.zeros((len(got), len(grams)))
    for row, (k, (i, w)) in enumerate(got.items()):
        want = np.array([(1 + np.log(lists[k].count(grams[x]))) * (np.log((1 + len(lists)) / (1 + met[grams[x]])) + 1) for x in i])
        assert set(i) == {x for x, g in enumerate(grams) if g in lists[k]} and np.allclose(w, want / np.sqrt(want @ want), atol=1e-12)
        dense[row, i] = w
    parts = {r["name"]: r["components"] for r in clusters.row_components(sparse, len(grams), "name", 4).collect()}
    v = np.linalg.svd(dense, full_matrices=False)[2][:4].T
    v = v * np.where(np.abs(v).max(axis=0) == v.max(axis=0), 1, -1)
    assert np.allclose(np.array([parts[k] for k in got]), dense @ v, atol=1e-8)
