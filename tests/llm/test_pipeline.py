import hashlib

import pytest

import corpus_pipeline
from querylens.llm import registry, toxicity
from querylens.llm.common import table

from ..oracle import connect, same
from .test_dedup import UPPER
from .test_texts import held

SF = "/root/testdata/sf0.001"


def test_queries_with_sql(spark):
    con = connect(SF)
    for name, sql in registry.SQL.items():
        same(con, sql, registry.QUERIES[name](spark, SF).toPandas())


def test_every_query_covers_its_table(spark):
    sizes = {t: table(spark, SF, t).count() for t in ("documents", "embeddings", "pages")}
    for name, query in registry.QUERIES.items():
        if name not in ("pipeline", "op10_packing"):
            t = "embeddings" if name.startswith("op7_") else "pages" if name.startswith("op8_") else "documents"
            assert query(spark, SF).count() == sizes[t], name


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept; near copies by exact five-word Jaccard."""
    from tokenizers import Tokenizer

    from querylens.llm import bpe

    docs = table(spark, SF, "documents")
    names = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    toxic = {r["doc_id"] for r in toxicity.grade(docs, table(spark, SF, "labels")).where("toxic").collect()}
    assert clean.columns == names and {r["doc_id"] for r in clean.collect()} == set(texts) - toxic
    single = stages["exact_dedup"](spark, clean, SF).cache()
    last = {}
    for i in set(texts) - toxic:
        key = hashlib.sha256((texts[i] or "").translate(UPPER).encode()).digest()
        last[key] = max(i, last.get(key, i))
    assert single.columns == names and {r["doc_id"] for r in single.collect()} == set(last.values())
    apart = stages["simhash_near_dedup"](spark, single, SF).cache()
    kept = {r["doc_id"] for r in apart.collect()}

    def shingles(t):
        w = (t or "").translate(UPPER).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = {i: shingles(texts[i]) for i in last.values()}
    near = {(a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    far = {i for i in s if not any(len(s[i] & s[j]) >= 0.4 * len(s[i] | s[j]) for j in s if j != i and (s[i] or s[j])) and s[i]}
    assert far <= kept and not any(a in kept and b in kept for a, b in near)
    private = stages["pii"](spark, apart, SF).cache()
    assert private.columns == names and private.schema == apart.schema
    after = {r["doc_id"]: r["text"] for r in private.collect()}
    assert set(after) == kept and all(r["n_chars"] == len(r["text"]) for r in private.where("text is not null").collect())
    assert any(after[i] != texts[i] for i in after) and all("@mail" not in (texts[i] or "") or after[i] != texts[i] for i in after)
    packed = stages["packing"](spark, private, SF).collect()
    held(packed, list(after.items()), Tokenizer.from_file(bpe.tokenizer_path()), 1024)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(str(r) for r in stages["packing"](spark, private, SF).drop("sequence_id", "offset").collect())


def odd_table(spark):
    """Null, repeated and shared ids, null, empty and long texts, ties, and columns that clash with names inside."""
    rows = [(1, None), (2, ""), (3, "Same TEXT of a document that stays"), (4, "same text of a document that stays"), (4, "same text of a document that stays"), (None, "same text of a document that stays"), (None, None), (5, "w " * 60_000), (6, "mail a@b.co at 10.0.0.1"), (6, "another text of the same id"), (7, " ".join(f"w{i}" for i in range(300))), (8, " ".join(f"w{i}" for i in range(299)))]
    names = "doc_id long, text string, lang string, source string, n_chars long, node long, k long, norm string, label int, f0 long, row long, f string, hits int, piece int, length long, kept boolean, component_id long, text_sha256 string"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "n", 3, 4, 5, "f", 6, 7, 8, True, 9, "x") for i, t in rows], names), rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, name):
    docs, rows = odd_table(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) if name != "packing" else out.collect()
    if name != "packing":
        assert out.schema == docs.schema
    if name == "toxicity":
        assert got == sorted(rows, key=str)
    elif name == "exact_dedup":  # rows without an id stay; of 1 and 2 the text is empty, 4 comes twice
        assert sorted(str(i) for i, _ in got) == sorted(map(str, (2, 4, 4, None, None, 5, 6, 6, 7, 8)))
    elif name == "simhash_near_dedup":
        assert sorted(str(i) for i, _ in got) == sorted(map(str, (1, 3, None, None, 5, 6, 6, 7)))
    elif name == "pii":
        assert len(got) == len(rows) and not any(t and "10.0.0.1" in t for _, t in got)
    else:
        assert sum(r["piece"] == 0 for r in got) == len(rows)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and (name == "packing" or empty.schema == docs.schema)


def test_run_is_its_stages_and_cannot_import_alone():
    import importlib
    import sys

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    assert importlib.import_module("querylens.llm.pipeline").STAGES is corpus_pipeline.STAGES and "corpus_pipeline" in sys.modules
