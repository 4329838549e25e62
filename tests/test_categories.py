"""The registered category query runs the whole stability search."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylens import catalog, plans  # noqa: F401
from querylens.operators import clusters
from querylens.plans import views

SF = "/root/testdata/sf0.01"


def test_gmm_categories_searches_for_stable_sizes(spark, monkeypatch):
    asked = []

    def one_class(df, key, most=8, rounds=8, least=0.75, seed=0):
        asked.append((most, rounds, least, df.count()))
        return df.select(key, F.lit(0).alias("label")), spark.createDataFrame([], "categories int, bic double, ari double, min_jaccard double")

    monkeypatch.setattr(clusters, "select_classes", one_class)
    out = catalog.QUERIES["gmm_categories"](spark, SF)
    n = views.chat(spark, SF).count()
    assert out.count() == n and asked == [(8, 8, 0.75, n)]


def test_fits_run_at_once_and_keep_their_order(spark):
    """Eight pieces of work wait for each other, which one by one they could not; results come in the order given."""
    import threading

    gate = threading.Barrier(clusters.FITS, timeout=20)
    assert clusters.at_once(spark.range(1), [lambda i=i: (gate.wait(), i)[1] for i in range(clusters.FITS)]) == list(range(clusters.FITS))


def test_fits_of_all_samples_take_one_pass_a_step(spark):
    """No more jobs for many fits than for one, and each is what plain steps over its own sample give."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(120, 3)) + 6 * (i - 1) for i in range(3)])
    x[:, 2] = np.round(x[:, 2]) * (x[:, 0] > 3)  # mostly one value
    rows = [(i, [float(v) for v in r], [True, i % 5 > 0, i % 3 > 0]) for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, "id long, x array<double>, member array<boolean>").repartition(3, "id").cache()
    asked = [(s, k, seed) for s in range(3) for k in (2, 3) for seed in (0, 1)]
    passes, to_arrow = [], type(points).toArrow

    def counted(self):
        passes.append(1)
        return to_arrow(self)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(points), "toArrow", counted)
        fits = clusters.mixtures(points, "id", 3, asked)
    assert [(f.sample, f.k, f.seed) for f in fits] == asked and len(passes) == max(f.steps for f in fits) < 100
    for f in fits:
        mine = x[[r[2][f.sample] for r in rows]]
        got = multivariate(mine, f)
        assert f.n == pytest.approx(len(mine)) and f.log_likelihood == pytest.approx(np.log(got.sum(axis=1)).sum(), rel=1e-6)
        owed = got / got.sum(axis=1, keepdims=True)
        assert np.allclose(owed.T @ mine / owed.sum(axis=0)[:, None], f.means, atol=0.2)  # at rest, but for what a last step may gain
    best = clusters.best_fits(fits)
    labels = {r["id"]: r["labels"] for r in clusters.classified(points, "id", best).collect()}
    assert all(labels[i] == [int(multivariate(x[i : i + 1], f).argmax()) for f in best] for i in range(len(x)))
    again = clusters.mixtures(points, "id", 3, asked)
    assert [f.log_likelihood for f in again] == pytest.approx([f.log_likelihood for f in fits], rel=1e-9)


def multivariate(x, f):
    out = []
    for w, m, c in zip(f.weights, f.means, f.covariances, strict=True):
        d = x - m
        out.append(w * np.exp(-0.5 * (d @ np.linalg.inv(c) * d).sum(axis=1)) / np.sqrt(np.linalg.det(2 * np.pi * c)))
    return np.stack(out, axis=1)


def test_agreement_of_cells_is_that_of_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 4, (200, 2))] + [(5, 5)] * 40
    d = spark.createDataFrame(rows, "a int, b int")
    ari, best = clusters.agreement([(a, b, n) for (a, b), n in Counter(rows).items()])
    assert ari == pytest.approx(clusters.rand_index(d, "a", "b").first()[0])
    assert best == pytest.approx({r["label"]: r["jaccard"] for r in clusters.best_jaccard(d, "a", "b").collect()})
    assert clusters.agreement([(0, 1, 7)])[0] == 1.0
