"""The near-duplicate queries over the log view."""


def test_near_queries_meet_the_whole_log(spark, tmp_path):
    from querylens import catalog, plans  # noqa: F401

    base = " ".join(f"word{i}" for i in range(60))
    texts = [base, base + " more", base + " many other words stand here, so that it is far below the threshold of similar texts, or so we hope and trust", "alone", base + " more", None]
    rows = [(7 * i if i != 4 else 29, t, "en", "web", 10) for i, t in enumerate(texts)]
    spark.createDataFrame([r for r in rows if r[1] is not None], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [tuple(r)[:2] for r in catalog.QUERIES["log_near_pairs"](spark, str(tmp_path)).collect()]
    assert pairs == [(0, 7)]
    got = {r["row_id"]: r["group_id"] for r in catalog.QUERIES["log_near_groups"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 7: 0, 14: 1, 21: 2, 29: 0}
    assert sorted((r["n_rows"], r["n_variants"]) for r in catalog.QUERIES["log_near_summary"](spark, str(tmp_path)).collect()) == [(1, 1), (1, 1), (3, 2)]


def test_similar_pairs_equal_brute_force_and_exchange_no_shingles(spark, monkeypatch):
    """All sizes, characters beyond 16 bits, null blocks, several blocks, and no table of shingles that is larger than the texts."""
    import random

    from querylens.operators import groups

    rng, rows = random.Random(3), []
    for k in range(60):
        base = "".join(rng.choice("abcdefgh 😀é") for _ in range(rng.choice((3, 4, 5, 60, 400, 2000))))
        for _ in range(4):
            t = list(base)
            for i in rng.sample(range(len(t)), rng.choice((0, 1, 1, len(t) // 60))):
                t[i] = rng.choice("xyz")
            rows.append((len(rows), "".join(t), rng.choice(("s", "s", "s", "t", None)), "d"))
    rows = [r for i, r in enumerate(rows) if (r[1], r[2]) not in {(x[1], x[2]) for x in rows[:i]}]
    written, made = {}, groups.materialize

    def kept(df, label):
        written[label] = made(df, label)
        return written[label]

    monkeypatch.setattr(groups, "materialize", kept)
    got = {(r["a"], r["b"]): r["similarity"] for r in groups.similar_pairs(spark.createDataFrame(rows, "id long, normalized string, source string, day string"), ["source", "day"], 0.8).collect()}
    s = [{t} if len(t) <= 4 else {t[i : i + 4] for i in range(len(t) - 3)} for _, t, _, _ in rows]
    want = {(a[0], b[0]): len(s[i] & s[j]) / len(s[i] | s[j]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a[2] and a[2] == b[2] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    assert got == want and len(want) > 20
    sent = sum(len(r["odd"]) for r in written["sketches"].collect())
    assert "shingles" not in written and sent < sum(len(r[1]) for r in rows)
