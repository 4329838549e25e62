import random

import numpy as np
import pytest

from querylens.llm import langid, toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.grade(docs, labels.where("doc_id % 2 = 0")).collect()}
    test = labels.where("doc_id % 2 = 1").collect()
    clean = [got[r["doc_id"]]["toxic"] for r in test if not r["toxic"]]
    toxic = [got[r["doc_id"]]["toxic"] for r in test if r["toxic"]]
    assert len(got) == docs.count() and np.mean(clean) < 0.01 and np.mean(toxic) > 0.8
    assert all(0 <= r["severity"] <= 1 and r["grade"] in (0, 1) and (r["grade"] == 1) == (r["severity"] > 0.5) for r in got.values())


def small(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" nastiest" if i % 4 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows] + [(100, None, "x", 1, 2.0), (101, "", "x", 1, 2.0), (102, "Nastiest! " * 20000, "x", 1, 2.0), (None, "nastiest", "x", 1, 2.0), (0, rows[0][1], "x", 1, 2.0)], "doc_id long, text string, features string, toxic int, grade double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(0, 1), (None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_odd_rows(spark):
    docs, labels = small(spark)
    got = [(r["doc_id"], r["toxic"]) for r in toxicity.grade(docs, labels).collect()]
    assert len(got) == 85
    assert all(t == (i is None or i == 102 or i < 80 and i % 4 == 0) for i, t in got)
    left = toxicity.without_toxic(docs, labels)
    assert left.schema == docs.schema and left.count() == 85 - 23
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.grade(docs, none).where("toxic").count() == 0
    assert toxicity.grade(docs.limit(0), labels).count() == 0


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.random((600, 6)) < 0.3
    score = x[:, 0] * 4.0 + x[:, 1] * 4.0
    grade = (score >= 4).astype(int) + (score >= 8)
    at, cols = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(at, cols, grade, 6)
    assert theta[0] < theta[1] and min(w[:2]) > 4 * np.abs(w[2:]).max()
    over = toxicity.Model({}, theta).over(x @ w)
    assert (np.abs(over.sum(axis=1) - grade) < 0.5).mean() > 0.97


def graded(spark, n=1200):
    """Texts of a known severity of 0 to 3: so many of three sets of rude words, with words that mean nothing."""
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    rude = [["".join(rng.choice("qrstuvw") for _ in range(7)) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(n):
        severity = rng.choice((0, 0, 0, 1, 2, 3))
        words = rng.choices(plain, k=25) + [rng.choice(rude[k]) for k in range(severity)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), severity))
    return rows, spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")


def test_severity_of_held_out_texts(spark):
    rows, docs = graded(spark)
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 2 == 0], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.grade(docs, labels).collect()}
    held = [(g, got[i]) for i, _, g in rows if i % 2]
    assert np.mean([abs(r["severity"] - g) for g, r in held]) < 0.25 and np.mean([r["grade"] == g for g, r in held]) > 0.9


def test_fit_is_the_optimum_over_all_features(spark):
    """The conditions of an optimum, worked out over every feature of every text; and each score, feature by feature."""
    rows, docs = graded(spark, 300)
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    grade = np.array([g for _, _, g in rows])
    held = [toxicity.text_features(t) for _, t, _ in rows]
    score = np.array([sum(model.weights.get(f, 0.0) for f in h) for h in held])
    p = 1 / (1 + np.exp(model.theta[None] - score[:, None]))
    r = (p - (grade[:, None] > np.arange(3))).sum(axis=1) / len(rows)
    slope, n = {}, {}
    for i, h in enumerate(held):
        for f in h:
            slope[f] = slope.get(f, 0.0) + r[i]
            n[f] = n.get(f, 0) + 1
    assert set(model.weights) < set(slope) and list(model.theta) == sorted(model.theta)
    for f, s in slope.items():
        if n[f] >= toxicity.LEAST_ROWS and f not in model.weights:
            assert abs(s) <= 1.05 * toxicity.PENALTY
        elif f in model.weights:
            assert abs(s + toxicity.PENALTY * np.sign(model.weights[f])) < 0.2 * toxicity.PENALTY
    got = {x["doc_id"]: x for x in toxicity.grade(docs, labels).collect()}
    for i, (k, _, _) in enumerate(rows):
        by_grade = np.diff(np.append(0.0, np.append(1 - p[i], 1.0)))
        assert abs(got[k]["severity"] - p[i].sum()) < 0.02 and got[k]["toxic"] == (p[i][0] >= 0.5) and (got[k]["grade"] == by_grade.argmax() or np.sort(by_grade)[-1] - np.sort(by_grade)[-2] < 0.02)


def test_codewords_are_far_apart():
    for n in (1, 2, 3, 4, 5, 9, 30):
        c = langid.codewords(n)
        assert c.shape[0] == n and set(np.unique(c)) <= {-1, 1}
        apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert not apart or min(apart) >= max(1, c.shape[1] // 5)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 2000 and (got.lang == got.lang_pred).mean() > 0.99 and got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in ((f"the cat and the hat {i}", "en"), (f"der hund und die katze {i}", "de"), (f"le chat et la maison {i}", None))]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, (_, t, lang) in enumerate(rows)] + [(900, None, "en", "s"), (901, "", None, "s"), (902, "12 :-)", "en", "s"), (None, "the hat", "en", "s"), (903, "der hund " * 20000, None, "s"), (903, "der hund " * 20000, None, "s")], "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == 126 and {r["lang_pred"] for r in got} == {"en", "de", "und"}
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[903]["lang_pred"] == "de"
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"]
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    untaught = langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 9)).where("false"))
    assert untaught.count() == 0
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_against_brute_force(spark):
    """Counts, weights, trust and decoding once more, by plain loops over dictionaries."""
    import zlib
    from collections import Counter
    from math import exp, log, log1p

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(10**6, "½ ²", "en"), (10**6 + 1, "Ⅷ ①", "en"), (10**6 + 2, "", "de"), (10**6 + 3, "x", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    cells = 1 << langid.CELLS_LOG2

    def trigrams(t):
        b = (" " + t.lower() + " ").encode()
        return [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B1 % 2**32) >> (32 - langid.CELLS_LOG2) for i in range(len(b) - 2)]

    learnt = [(t, lang) for i, t, lang in rows if t and lang and zlib.crc32(str(i).encode()) % 4 != 2 and any(c.isalpha() for c in t)]
    langs = sorted({x for _, x in learnt})
    counts = {x: Counter() for x in langs}
    for t, x in learnt:
        counts[x].update(trigrams(t))
    code = langid.codewords(len(langs))
    whole = {x: sum(counts[x].values()) + 0.5 * cells for x in langs}

    def weight(b, c):
        halves = [[(counts[x][c] + 0.5) / whole[x] for k, x in enumerate(langs) if code[k][b] == side] for side in (1, -1)]
        return log(sum(halves[0]) / len(halves[0])) - log(sum(halves[1]) / len(halves[1]))

    known = {}

    def margins(t):
        c = Counter(trigrams(t))
        out = []
        for b in range(code.shape[1]):
            for x in c:
                if (b, x) not in known:
                    known[b, x] = weight(b, x)
            out.append(langid.SHARPNESS * sum(n * known[b, x] for x, n in c.items()) / sum(c.values()))
        return out

    right = [[[0, 0] for _ in range(code.shape[1])] for _ in langs]
    for t, x in learnt:
        k = langs.index(x)
        for b, m in enumerate(margins(t)):
            right[k][b][0] += bool(code[k][b] * m > 0)
            right[k][b][1] += 1
    trust = [[(ok + 1) / (n + 2) for ok, n in r] for r in right]
    trust = [[x / sum(r) for x in r] for r in trust]
    for i, t, _ in rows[:80] + odd:
        if not t or i in (10**6, 10**6 + 1):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        m = margins(t)
        loss = [sum(code.shape[1] * trust[k][b] * (log1p(exp(-abs(z))) + max(z, 0)) for b in range(code.shape[1]) for z in [-code[k][b] * m[b]]) for k in range(len(langs))]
        best = min(range(len(langs)), key=lambda k: loss[k])
        score = 1 / sum(exp(loss[best] - x) for x in loss)
        assert got[i]["lang_pred"] == langs[best] and abs(got[i]["score"] - score) < 1e-4


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "the cat", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"en"}


def test_threshold_is_between(spark):
    docs, labels = small(spark)
    assert toxicity.grade(docs, labels, threshold=1.1).where("toxic").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        toxicity.grade(docs.drop("text"), labels).count()
