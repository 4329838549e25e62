import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from querylens.llm import embeddings, exact_dedup, gray_index, simhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_documents(spark):
    """Nulls, empties, a long text, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "Same TEXT"), (4, "same text"), (5, "sämE text"), (6, "SÄME text"), (7, "w " * 20000), (8, "W " * 20000), (4, "same text"), (None, "same text"), (9, "alone \U0001f600")]
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], "doc_id long, text string, k string, norm string, node int, label int"), rows


def test_exact_dedup_odd_rows(spark):
    docs, rows = odd_documents(spark)
    for bits in (64, 2):  # two bits of key make chains
        got = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs, key_bits=bits, bucket_bytes=5000).collect())
        want = []
        for i, t in rows:
            n = (t or "").translate(UPPER)
            same = [j for j, u in rows if (u or "").translate(UPPER) == n]
            keep = max(j for j in same if j is not None)
            want.append((i or -1, keep, len(same), i == keep, hashlib.sha256(n.encode()).hexdigest()))
        assert got == sorted(want)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 4, 4, 5, 6, 8, 9]


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def random_documents(spark, n=2000):
    rng = random.Random(1)
    return spark.createDataFrame([(i, "%030x" % rng.getrandbits(120)) for i in range(n)], "doc_id long, text string")


def test_directory_splits_overfull_buckets(spark):
    index = exact_dedup.build_index(random_documents(spark), bucket_bytes=10_000).entries.toPandas()
    per = index.groupby("bucket").size()
    assert len(index) == 2000 and (per * exact_dedup.ENTRY_BYTES <= 10_000).all() and len(per) > 25
    assert index.groupby("bucket").local_depth.nunique().max() == 1
    assert (index.bucket.str.len() - 1 == index.local_depth).all()


def test_lookup_goes_by_the_directory(spark):
    docs = random_documents(spark, 400)
    index = exact_dedup.build_index(docs, bucket_bytes=10_000)
    right = exact_dedup.verdicts(docs, index)
    assert right.count() == right.where("kept").count() == 400
    names = [r["bucket"] for r in index.directory.select("bucket").distinct().orderBy("bucket").collect()]
    wrong = index.directory.replace(dict(zip(names, names[1:] + names[:1], strict=True)), subset=["bucket"])
    assert exact_dedup.verdicts(docs, index._replace(directory=wrong)).count() == 0


def test_a_split_writes_one_buckets_entries(spark):
    import glob

    docs = random_documents(spark, 400)
    index = exact_dedup.build_index(docs, bucket_bytes=40_000)
    sizes = sorted((r["count"], r["bucket"]) for r in index.entries.groupBy("bucket").count().collect())
    assert len(sizes) == 2 and sizes[0][0] < sizes[1][0]
    place = index.path.removeprefix("file://")

    def files():
        return {f: open(f, "rb").read() for f in glob.glob(f"{place}/bucket=*/*.parquet")}

    before = files()
    grown = exact_dedup.split_overfull(index, sizes[0][0] * exact_dedup.ENTRY_BYTES)
    after = files()
    gone = {f.split("bucket=")[1].split("/")[0] for f in before if f not in after}
    new = {f.split("bucket=")[1].split("/")[0] for f in after if f not in before}
    assert gone == {sizes[1][1]} and new == {sizes[1][1] + "0", sizes[1][1] + "1"} and grown.depth == index.depth + 1
    assert all(after[f] == before[f] for f in before if f in after)
    got = exact_dedup.verdicts(docs, grown)
    assert got.count() == got.where("kept").count() == 400


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**16 - 1), min_size=1, max_size=300), st.integers(0, 4))
def test_gray_index_finds_all(codes, radius):
    codes = np.array(codes, np.uint64)
    index = gray_index.GrayIndex(codes, leaf=4)
    got = {(int(a), int(b)) for q, at in index.search(codes, radius, chunk=37) for a, b in zip(q, at, strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= radius}
    assert got == want


def test_near_queries_go_down_as_one(monkeypatch):
    """Both sides are walked down together, so codes that look for each other take far fewer comparisons than each by itself."""
    codes, looked, count = np.random.default_rng(4).integers(0, 2**28, 20_000, np.uint64), [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (looked.append(x.size), count(x))[1])
    for asked in (codes, codes[:50], codes[:1]):
        looked.clear()
        got = {(int(a), int(b)) for q, at in gray_index.GrayIndex(codes).search(asked, 2) for a, b in zip(q, at, strict=True)}
        work = sum(looked) / len(asked)
        assert got == {(i, int(j)) for i in range(50) for j in np.flatnonzero(count(codes[i] ^ codes) <= 2) if i < len(asked)} | {x for x in got if x[0] >= 50}
        assert len(asked) < len(codes) or work < 700


def test_sketches_are_read_as_they_lie():
    """Also from columns in parts, and from slices."""
    rng = np.random.default_rng(8)
    rows = [rng.integers(0, 256, 8 * simhash.SKETCH, dtype=np.uint8).tobytes() for _ in range(50)]
    for column in (pa.array(rows), pa.chunked_array([rows[:20], rows[20:]]), pa.chunked_array([pa.array([b"x" * 64, *rows]).slice(1), pa.array([], pa.binary())])):
        got = np.array(simhash._words(column)).T
        assert [x.tobytes() for x in got] == rows


def test_gray_rank_orders_neighbours_by_one_bit():
    order = np.argsort(gray_index.gray_rank(np.arange(256, dtype=np.uint64)))
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


def slow_fingerprint(text):
    low = (text or "").translate(UPPER).encode()
    w = low.split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fingerprints, radius):
    root = list(range(len(fingerprints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fingerprints))]


def test_simhash_is_exact_for_one_slice(spark):
    docs, rows = odd_documents(spark)
    rows = [(i, t) for i, t in rows if i is not None]
    got = simhash.simhash_components(docs, words=3, width=1, slice_bits=64, slice_radius=2, radius=2).collect()
    f = [slow_fingerprint(t) for _, t in rows]
    c = components(f, 2)
    want = sorted((i, f[k], min(j for m, (j, _) in enumerate(rows) if c[m] == c[k])) for k, (i, _) in enumerate(rows))
    assert sorted((r["doc_id"], r["f0"] % 2**64, r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_simhash_query_against_brute_force(spark):
    from querylens.llm import registry

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    f = [slow_fingerprint(t) for _, t in rows]
    c = components(f, 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{f[k]:016x}", rows[c[k]][0]) for k, (i, _) in enumerate(rows)}


def test_full_blocks_are_cut_and_common_codes_dealt(spark):
    """Blocks of 16 rows at most, codes that crowd in one corner, and in slices the same code many times over: the links are those of brute force."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, np.uint64)
    near = base[rng.integers(0, 20, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    corner = np.uint64(5) << np.uint64(58) | rng.integers(0, 2**12, 300).astype(np.uint64)
    f = np.unique(np.concatenate([base, near, corner, rng.integers(0, 2**63, 300, np.uint64)]))
    df = spark.createDataFrame([(i, int(x.view(np.int64))) for i, x in enumerate(f)], "node long, f0 long")
    diff = np.bitwise_count(f[:, None] ^ f[None])
    half = [f >> np.uint64(s) & np.uint64(2**32 - 1) for s in (0, 32)]
    near_half = [np.bitwise_count(h[:, None] ^ h[None]) <= 1 for h in half]

    def classes_of(u, v):
        label = np.arange(len(f))
        gray_index.unite(label, u, v)
        return label

    for bits, slice_radius, radius, links in ((64, 2, 2, diff <= 2), (32, 1, 6, (near_half[0] | near_half[1]) & (diff <= 6))):
        found = simhash.near_edges(df, 1, bits, slice_radius, radius, block_rows=4, least_blocks=8).collect()
        want, got = classes_of(*np.nonzero(np.triu(links, 1))), classes_of(np.array([r["a"] for r in found]), np.array([r["b"] for r in found]))
        assert (want == got).all() and len(np.unique(want)) < len(f)


def test_slices_grow_with_the_number_of_sets():
    """Codes that meet a set by chance do not rise from a hundred thousand sets to ten billion."""
    from math import comb

    for n in (10**5, 10**6, 10**7, 10**8, 10**9, 10**10):
        _, bits, r, _ = simhash.slices_for(n)
        assert n * sum(comb(bits, i) for i in range(r + 1)) / 2**bits <= 2


def test_candidates_of_random_codes_do_not_grow():
    rng, met = np.random.default_rng(5), []
    for n in (100_000, 1_000_000):
        _, bits, r, _ = simhash.slices_for(n)
        codes = rng.integers(0, 2**bits, n, np.uint64)
        met.append(sum(len(q) for q, _ in gray_index.GrayIndex(codes).search(codes[:500], r)) / 500 - 1)
    assert met[1] <= 2 and met[0] <= 2


def test_recall_of_planted_pairs(spark):
    """Of pairs at a similarity of 0.80 to 0.85 at least nine in ten are found, by the index alone."""
    rng = random.Random(11)
    texts, planted = [], 0
    for k in range(400):
        words = [f"w{k}_{i}" for i in range(104 + rng.randrange(300))]
        own = len(words) - 4
        changed = int(own * rng.uniform(0.0815, 0.11))  # a run at the end, so each word changes one shingle
        j = (own - changed) / (own + changed)
        planted += 0.8 <= j <= 0.85
        texts += [" ".join(words), " ".join(words[:-changed] + [f"x{k}_{i}" for i in range(changed)])]
        if not 0.8 <= j <= 0.85:
            texts = texts[:-2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.near_deduplicated(df).count()
    assert planted > 300 and 2 * planted - kept >= 0.95 * planted


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    docs = [" ".join(rng.sample(words, 300)) for _ in range(40)]
    near = []
    for d in docs[:20]:  # three words changed: a similarity of about 0.9
        w = d.split()
        for i in rng.sample(range(300), 3):
            w[i] = "changed"
        near.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(docs + near)) + [(None, docs[0])], "doc_id long, text string")
    kept = [r["doc_id"] for r in simhash.near_deduplicated(df).collect()]
    assert set(kept) >= set(range(40)) | {None} and len([k for k in kept if k and k >= 40]) <= 1


def test_simhash_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    near = base[:60] + rng.normal(scale=0.04, size=(60, 16))
    v = np.concatenate([base, near, base[:10], 3 * base[10:20]])
    label = [int(i % 60 % 4) if i % 60 != 7 else None for i in range(len(v))]
    rows = [(i, [float(x) for x in a], label[i]) for i, a in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (906, [], 1), (None, [1.0] * 16, 1), (907, [float("inf")] + [1.0] * 15, 1), (900, None, 1)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    good = [i for i, (k, e, lab) in enumerate(rows) if k is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98:
                links[i].add(j)
    reach = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        reach[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    want = sorted((rows[i][0] if rows[i][0] is not None else -1, len(links[i]), reach[i]) for i in links)
    for block in (16, 1024):
        got = embeddings.embedding_links(df, block=block).collect()
        assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert sum(len(x) for x in links.values()) > 100


def test_embeddings_of_any_size(spark):
    """Tiny, subnormal and huge vectors link by their cosine like any others."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in v * scale], 1) for i, (v, scale) in enumerate(zip(base[:4], (1e-200, 1e200, 1e-300, 1e300), strict=True))]
    rows += [(200, [1e-200] + [0.0] * 7, 1), (201, [5e-324] + [0.0] * 7, 1), (202, [1e308] + [0.0] * 7, 1)]
    got = {r["vec_id"]: r for r in embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows) and all(got[100 + i]["component_id"] == got[i]["component_id"] and got[100 + i]["n_links"] >= 1 for i in range(4))
    assert {got[i]["component_id"] for i in (200, 201, 202)} == {200} and got[200]["n_links"] == 2


def test_embeddings_empty(spark):
    assert embeddings.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def exact_kept(texts, threshold=0.8):
    """Indices that stay of texts, by the exact Jaccard similarity of all pairs."""
    s = []
    for t in texts:
        w = t.translate(UPPER).split()
        s.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(s)))
    for _ in s:  # labels spread along links until nothing changes
        new = [min([root[i], *(root[j] for j in range(len(s)) if j != i and (s[i] == s[j] or len(s[i] & s[j]) / len(s[i] | s[j]) >= threshold))]) for i in range(len(s))]
        if new == root:
            break
        root = new
    return [i for i in range(len(s)) if root[i] == i]


def mutated(rng, base, changes):
    w = base.split()
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"x{rng.random()}"
    return " ".join(w)


def test_near_copies_are_verified_exactly(spark):
    rng = random.Random(7)
    texts = []
    for k in range(60):  # pairs on both sides of 0.8, a large group of near copies, and a chain
        base = " ".join(f"w{k}_{i}" for i in range(150 + 3 * k))
        texts += [base, mutated(rng, base, 1 + k % 8)]
    hub = " ".join(f"hub{i}" for i in range(200))
    texts += [mutated(rng, hub, 2) for _ in range(60)] + ["", " ", "one two", "ONE  two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.near_deduplicated(df).collect())
    want = exact_kept(texts)
    assert kept == want and 60 < len(want) < 120


def test_repeated_lines_do_not_outvote_the_rest(spark):
    rng = random.Random(9)
    line = " ".join(f"menu{i}" for i in range(13))
    own = [" ".join(f"d{k}_{i}" for i in range(100)) for k in range(6)]
    clean = [f"{t} " + " ".join([line] * 20) for t in own]  # one line 20 times, a set similarity of 0.06
    long = [" ".join(f"e{k}_{i}" for i in range(400)) for k in range(6)]
    once = [f"{t} {line} {line}" for t in long]
    often = [f"{mutated(rng, t, 1)} " + " ".join([line] * 200) for t in long]  # the same sets but for a few shingles
    texts = clean + once + often
    kept = sorted(r["doc_id"] for r in simhash.near_deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert kept == exact_kept(texts) == list(range(12))


def test_sketches_never_rule_out_a_link():
    """Sketches differ in no more bits than their sets in elements, at any size."""
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 100, 3000, 20_000):
        a = rng.integers(0, 2**64, n, np.uint64)
        for changed in (0, n // 20, n // 5, n):
            b = np.concatenate([a[changed:], rng.integers(0, 2**64, changed, np.uint64)])
            x, y = (np.frombuffer(simhash.parities(np.unique(h)), np.uint64) for h in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) and (changed or (x == y).all())


def test_a_shared_passage_brings_no_square_of_pairs(spark, monkeypatch):
    """200 texts that share two thirds and more, below the threshold, and a few links: what is verified stays in proportion; rounds of one slice give the same."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(240))
    texts = [passage + " " + " ".join(f"o{k}_{i}" for i in range(45)) for k in range(200)]
    texts += [mutated(rng, t, 2) for t in texts[:20]]
    df, looked, verified = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], simhash._verified

    def counted(pairs, *more):
        looked.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "_verified", counted)
    kept = sorted(r["doc_id"] for r in simhash.near_deduplicated(df).collect())
    assert kept == exact_kept(texts) and sum(looked) < 5 * len(texts)
    monkeypatch.setattr(simhash, "SENT_ROWS", 1)
    assert kept == sorted(r["doc_id"] for r in simhash.near_deduplicated(df).collect())
