"""SimHash near-dedup over a Gray-order hierarchical index (operator 2).

Fingerprints that are equal are one class from the start, so a large group of
copies costs one entry. The Gray order is cut into blocks by the leading bits
that their fingerprints share; a block that holds too many is cut again, by
further bits. These upper nodes follow from the bits alone: a fingerprint is
sent to the nodes whose shared bits differ from its own by no more than the
radius, and what has differed already counts in the nodes below. Inside a
block a task searches its own hierarchical index and sends back a spanning
forest of the links that it has found, never the pairs themselves.
Near-copies by set similarity take two rounds: the index only proposes pairs,
and each is verified by the exact Jaccard similarity before it is an edge.
Each set carries a sketch as well, the parities of its hashes by place. Sets
differ in at least as many elements as their sketches do in bits, so a task
rules out, without an error, most pairs that lie below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import drop_table, id_text, materialize, release_exchanges, texts
from .gray_index import GrayIndex, gray_rank, spanning, unite

#: Rows of a block of the index, the least number of blocks (for the tasks to share), bits of a further cut, and rows routed at once.
BLOCK_ROWS, LEAST_BLOCKS, CUT_BITS, ROUTED = 131_072, 32, 4, 1 << 17
#: Rows of a block where slices propose pairs: what a class is sent to grows with the number of blocks.
PROPOSING_ROWS = 262_144
#: One in each byte of a word, and rows whose ones a byte can count.
LANES, ROWS = np.uint64(0x0101010101010101), 255
#: Words of a fingerprint that a proposal compares as a whole.
COMPARED = 2
#: Words of a set's sketch of parities.
SKETCH = 8
#: Rows for each class that are sent to blocks at once; more slices than these allow take further rounds, so that the exchange does not outgrow the disk.
SENT_ROWS = 24
#: Slices by which a first look finds the groups of near copies, so that not all of their pairs are proposed by all slices.
FIRST_SLICES = 2


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of the text, A-Z in lower case, repeats included."""
    w = text.encode("utf-8", "replace").lower().split()  # of bytes: both touch ASCII alone
    n, digest = len(w), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(b" ".join(w), 42)] if n else [], np.uint64)
    return np.fromiter((digest(b" ".join(s), 42) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, n - words + 1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash made of a hash (k = 0: itself), by the finaliser of splitmix64."""
    if not k:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, width: int = 1) -> np.ndarray:
    """width words of 64 bits; a bit is 1 if it is set in over half the hashes. No hash: zero."""
    if not len(h):
        return np.zeros(width, np.uint64)
    ones = np.zeros((width, 8, 8), np.int64)  # by word, bit of a byte, byte
    for i in range(0, len(h), 64 * ROWS):
        part = h[i : i + 64 * ROWS]
        m = np.zeros((width, -(-len(part) // ROWS) * ROWS), np.uint64)
        for k in range(width):
            m[k, : len(part)] = _mixed(part, k)
        m = m.reshape(width, -1, ROWS)
        for bit in range(8):  # eight counters a word, one in each byte, which so many rows cannot overflow
            ones[:, bit] += ((m >> np.uint64(bit)) & LANES).sum(axis=2, dtype=np.uint64).view(np.uint8).reshape(width, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits((2 * ones > len(h)).transpose(0, 2, 1).reshape(width, 64), axis=1, bitorder="little").view(np.uint64).ravel()


def parities(h: np.ndarray) -> bytes:
    """SKETCH words: for each place, whether an odd number of the distinct hashes falls there."""
    at = (_mixed(h, 1 << 20) >> np.uint64(32)) % np.uint64(64 * SKETCH)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).tobytes()


def _words(column) -> list[np.ndarray]:
    """A column of sketches as an array for each of their words."""
    rows = np.empty((len(column), 8 * SKETCH), np.uint8)
    start = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        fixed = chunk.cast(pa.binary(8 * SKETCH))
        rows[start : start + len(fixed)] = np.frombuffer(fixed.buffers()[1], np.uint8).reshape(-1, 8 * SKETCH)[fixed.offset : fixed.offset + len(fixed)]
        start += len(fixed)
    return list(rows.view(np.uint64).T.copy())


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and f0, f1, ... (64 bits each, as signed longs) of each row's whole text."""
    names = [f"f{k}" for k in range(width)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(shingle_hashes(t, words), width) for t in texts(batch.column("text"))], np.uint64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(f[:, k].view(np.int64)) for k in range(width))], ["doc_id", *names])

    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(of, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def _masks(bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All words of so many bits of which radius at most are set, with how many."""
    found = [np.zeros(1, np.uint64)]
    for n in range(1, min(bits, radius) + 1):
        found.append(np.array([sum(1 << i for i in c) for c in combinations(range(bits), n)], np.uint64))
    return np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])


def _blocks(classes: DataFrame, tables: range, slice_bits: int, radius: int, codes, columns: list[str], block_rows: int, least_blocks: int) -> DataFrame:
    """Rows (t, depth, prefix, chunk, home, code, columns...): each class at every block of each table that can hold a code within the radius.

    Of two blocks the one that is later in Gray order gets both codes. home
    tells a block's own codes from those that only ask. Blocks with more than
    four times block_rows are cut by further bits, down to single codes; a code
    that is still too frequent is dealt to chunks, and asks all of them.
    """
    depth = min(slice_bits, max(0, int(np.ceil(np.log2(max(classes.count() / block_rows, least_blocks / len(tables), 1))))))
    kinds = ", ".join(f"{x} {classes.schema[x].dataType.simpleString()}" for x in columns)
    node_schema = f"t int, depth int, prefix long, code long, home boolean, budget int, {kinds}"

    def expanded(batch: pa.RecordBatch, t, code, prefix, home, budget, was: int, now: int, rows) -> Iterator[pa.RecordBatch]:
        """Of nodes with was bits those below with now bits that are still within the budget."""
        masks, ones = _masks(now - was, radius)
        own = code >> np.uint64(slice_bits - now) if now else np.zeros(len(code), np.uint64)
        for s in range(0, len(code), step := max(1, ROUTED // len(masks))):
            low = own[s : s + step, None] & np.uint64((1 << (now - was)) - 1)
            child = (prefix[s : s + step, None] << np.uint64(now - was)) | (low ^ masks[None])
            left = budget[s : s + step, None] - ones[None]
            mine = home[s : s + step, None]
            there = (left >= 0) & (~mine | (gray_rank(child) >= gray_rank(own[s : s + step])[:, None]))
            i, j = np.nonzero(there)
            at = pa.array(rows[s + i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[s + i].astype(np.int32)), pa.array(np.full(len(i), now, np.int32)), pa.array(child[i, j].view(np.int64)), pa.array(code[s + i].view(np.int64)), pa.array(mine[i, 0] & (child[i, j] == own[s + i])), pa.array(left[i, j].astype(np.int32)), *(batch.column(x).take(at) for x in columns)],
                ["t", "depth", "prefix", "code", "home", "budget", *columns],
            )

    def first(batches):
        for batch in batches:
            n = batch.num_rows
            for t in tables:
                yield from expanded(batch, np.full(n, t), codes(batch, t), np.zeros(n, np.uint64), np.ones(n, bool), np.full(n, radius), 0, depth, np.arange(n))

    def further(was: int, now: int):
        def of(batches):
            for batch in batches:
                t, code, prefix, home, budget = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("t", "code", "prefix", "home", "budget"))
                yield from expanded(batch, t, code.view(np.uint64), prefix.view(np.uint64), home, budget, was, now, np.arange(batch.num_rows))

        return of

    def owners(batches):
        for batch in batches:
            for t in tables:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(codes(batch, t).view(np.int64))], ["t", "code"])

    # blocks that are too full: as many rows as there are such blocks, and hardly ever one
    owned, full, now = classes.mapInArrow(owners, "t int, code long"), [], depth
    while True:
        prefix = F.shiftrightunsigned("code", slice_bits - now) if now else F.lit(0).cast("long")
        counted = owned.groupBy("t", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * block_rows)
        full.append(materialize(counted.withColumn("depth", F.lit(now)), "full-blocks"))
        if now == slice_bits or full[-1].isEmpty():
            break
        owned = owned.withColumn("prefix", prefix).join(full[-1].select("t", "prefix"), ["t", "prefix"], "left_semi").select("t", "code")
        now = min(slice_bits, now + CUT_BITS)
    sent, out = classes.mapInArrow(first, node_schema), []
    keep = ["t", "depth", "prefix", F.lit(0).alias("chunk"), "home", "code", *columns]
    for k, counted in enumerate(full):
        if counted.isEmpty():
            out.append(sent.select(*keep))
            break
        was = min(slice_bits, depth + k * CUT_BITS)
        marked = sent.join(counted.select("t", "prefix", F.col("n").alias("_n")), ["t", "prefix"], "left")
        out.append(marked.where("_n is null").select(*keep))
        inner = marked.where("_n is not null")
        if was == slice_bits:  # one code many times over
            chunks = F.ceil(F.col("_n") / block_rows).cast("int")
            mine = F.pmod(F.xxhash64("node"), chunks).cast("int")
            dealt = inner.withColumn("_mine", mine).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
            out.append(dealt.select("t", "depth", "prefix", "chunk", (F.col("home") & (F.col("chunk") == F.col("_mine"))).alias("home"), "code", *columns))
        else:
            sent = inner.select("t", "depth", "prefix", "code", "home", "budget", *columns).mapInArrow(further(was, min(slice_bits, was + CUT_BITS)), node_schema)
    return reduce(DataFrame.union, out)


def near_edges(classes: DataFrame, width: int, slice_bits: int, slice_radius: int, radius: int, propose: str | None = None, ratio: float = 0.0, block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS, slices: range | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly the classes (node, f0, f1, ...) which links connect.

    A link: some slice of slice_bits differs in slice_radius bits at most, and
    the first COMPARED words together in radius bits at most. With one slice that
    holds all bits both are the same, and the result is exact.

    With propose the classes have n, the size of their set, odd, its sketch, and part
    as well, and the edges are links themselves, between sets whose sizes and
    sketches do not rule out a Jaccard similarity of ratio: "forest" gives those that span each
    block, near ones first, "all" every link between different parts, mostly
    once: in the first of the compared slices that finds it. slices: which of the slices to look at, if not all.
    """
    per_word = 64 // slice_bits
    tables, names = slices or range(width * per_word), [f"f{k}" for k in range(width)]
    compared = names[:COMPARED] if width * per_word > 1 else []
    more = ["n", "part", "odd"] if propose else []
    mask = np.uint64(2**slice_bits - 1)

    def codes(batch, t: int) -> np.ndarray:
        return (batch.column(names[t // per_word]).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(slice_bits * (t % per_word))) & mask

    def of_block(rows) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        return rows.column("node").to_numpy(), rows.column("code").to_numpy().view(np.uint64), [rows.column(x).to_numpy().view(np.uint64) for x in compared], rows.column("home").to_numpy(zero_copy_only=False)

    def apart(f: list[np.ndarray], q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(x[q] ^ x[at]).astype(np.int32) for x in f), np.zeros(len(q), np.int32))

    def linked(key, rows):
        node, c, f, home = of_block(rows)
        home, label = np.flatnonzero(home), np.arange(len(node))
        if len(home):
            for q, at in GrayIndex(c[home]).search(c, slice_radius):
                at = home[at]
                near = apart(f, q, at) <= radius
                unite(label, q[near], at[near])
        out = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": node[out], "b": node[label[out]]})

    def proposed(key, rows):
        node, c, f, is_home = of_block(rows)
        n, part = (rows.column(x).to_numpy() for x in more[:2])
        odd, most_odd = _words(rows.column("odd")), (1 - ratio) / (1 + ratio)
        home, label, found = np.flatnonzero(is_home), np.unique(part, return_inverse=True)[1], []
        for q, at in GrayIndex(c[home]).search(c, slice_radius) if len(home) else ():
            at = home[at]
            ok = (label[q] != label[at]) & (~is_home[q] | (node[q] < node[at])) & (np.minimum(n[q], n[at]) >= ratio * np.maximum(n[q], n[at]) - 1e-9)
            q, at = q[ok], at[ok]
            far = apart(f, q, at)
            ok = far <= radius
            q, at, far = q[ok], at[ok], far[ok]
            ok = apart(odd, q, at) <= most_odd * (n[q] + n[at]) + 1e-6  # sets that differ in more elements lie below the ratio
            q, at, far = q[ok], at[ok], far[ok]
            if propose == "forest":
                for most in (radius // 4, radius // 2, radius * 3 // 4, radius):
                    ok = far <= most
                    found += spanning(label, q[ok], at[ok])
            else:
                for u in range(min(key[0].as_py(), per_word * len(compared))):  # a pair that an earlier slice finds too is that slice's
                    x = (f[u // per_word] >> np.uint64(slice_bits * (u % per_word))) & mask
                    ok = np.bitwise_count(x[q] ^ x[at]) > slice_radius
                    q, at = q[ok], at[ok]
                found.append((q, at))
        a, b = (np.concatenate([node[:0], *(node[x[k]] for x in found)]) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    sent = _blocks(classes, tables, slice_bits, slice_radius, codes, ["node", *compared, *more], block_rows, least_blocks)
    return sent.groupBy("t", "depth", "prefix", "chunk").applyInArrow(proposed if propose else linked, "a long, b long")


def slices_for(n: int, threshold: float = 0.8, recall: float = 0.98, most: float = 2.0) -> tuple[int, int, int, int]:
    """(words, bits of a slice, its radius, radius of the compared words) to look for sets with a Jaccard similarity of threshold among n.

    Slices grow with the logarithm of n, so that at most so many codes that have
    nothing to do with a set are within the radius of its own. Their number is
    such that a pair at the threshold meets in one of them with the probability
    recall; of the ways to do so the cheapest is taken, by the nodes that a
    search visits and, worth a hundred of these each, the words of a fingerprint.
    """
    apart = np.arccos(2 * threshold / (1 + threshold)) / np.pi  # the share of bits that differ, for sets of equal size
    ways = []
    for bits in (24, 28, 32, 40, 48, 56, 64):
        for radius in (2, 3, 4):
            if n * sum(comb(bits, i) for i in range(radius + 1)) <= most * 2.0**bits:
                p = sum(comb(bits, i) * apart**i * (1 - apart) ** (bits - i) for i in range(radius + 1))
                tables = int(np.ceil(np.log(1 - recall) / np.log(1 - p)))
                words = -(-tables // (64 // bits))
                ways.append((tables * sum(comb(15, i) for i in range(radius + 1)) + 100 * words, words, bits, radius))
    if not ways:
        raise ValueError("too many sets for slices of 64 bits")
    _, words, bits, radius = min(ways)
    compared = 64 * min(words, COMPARED)
    return words, bits, radius, int(np.ceil(compared * apart + 3.5 * np.sqrt(compared * apart * (1 - apart))))


def simhash_components(docs: DataFrame, words: int = 3, width: int = 1, slice_bits: int = 64, slice_radius: int = 2, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, f0, f1, ..., component_id.

    component_id is the smallest doc_id that links reach, its own included. A
    null text counts as empty; texts without a word have the fingerprint zero,
    linked like any other. Rows with a null doc_id get a null component and link
    nothing. Repeated rows come out as often as they come in. Links are those of
    the fingerprints alone; near_components() verifies them.
    """
    names = [f"f{k}" for k in range(width)]
    marked = materialize(fingerprints(docs, words, width, id_col, text_col), "fingerprints")
    known = marked.where("doc_id is not null")
    classes = materialize(known.groupBy(*names).agg(F.min("doc_id").alias("node")), "classes")
    found = connected_components(near_edges(classes, width, slice_bits, slice_radius, radius))
    classes = classes.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return known.join(classes, names).select("doc_id", *names, "component_id").union(marked.where("doc_id is null").select("doc_id", *names, F.lit(None).cast("long").alias("component_id")))


def _set_key(h: np.ndarray) -> int:
    """A hash of a sorted set of hashes, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).view(np.int64))


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, words: int, threshold: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets of shingles have a Jaccard similarity of threshold or more.

    Only the texts that some pair needs are read again, by their smallest id.
    """

    def sets(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                h = [np.unique(shingle_hashes(t, words)) for t in texts(batch.column("text").slice(i, 256))]
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(x) for x in h], pa.int64()), pa.array([x.view(np.int64) for x in h], pa.list_(pa.int64()))], ["node", "s"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = classes.join(needed, "node").select("doc_id").distinct()
    found = rows.join(ids, "doc_id").select("text").mapInArrow(sets, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))
    found = materialize(found.join(needed, "node", "left_semi"), "sets")
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(found.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")) >= threshold).select("a", "b")


def _slices_at_once(classes: int, slice_bits: int, slice_radius: int) -> int:
    """How many slices may be sent to blocks together; a class goes to half of the blocks within the radius of its own."""
    depth = min(slice_bits, max(0, int(np.ceil(np.log2(max(classes, 1) / PROPOSING_ROWS)))))
    return max(1, int(SENT_ROWS / ((sum(comb(depth, i) for i in range(slice_radius + 1)) + 1) / 2)))


def near_components(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of each row with an id.

    A link: the sets of five-word shingles have a Jaccard similarity of
    threshold or more, decided exactly. Which pairs are looked at the index over
    fingerprints of the sets proposes; slices_for() tells their width. Equal sets
    are one class. A forest of what a few slices propose is verified first; then
    all proposals between the components that this has left, so that large groups do not bring
    all of their pairs. A null text counts as empty; repeated rows come out as
    often as they come in; an empty table gives an empty result.
    """
    width, slice_bits, slice_radius, radius = slices_for(max(1, docs.count()), threshold, recall)
    names = [f"f{k}" for k in range(width)]

    def of(batches):
        for batch in batches:
            rows_, odd = [], []
            for t in texts(batch.column("text")):
                h = np.unique(shingle_hashes(t, words))
                rows_.append((_set_key(h), len(h), *fingerprint(h, width).view(np.int64).tolist()))
                odd.append(parities(h))
            made = np.array(rows_, np.int64).reshape(-1, 2 + width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(made[:, k]) for k in range(2 + width)), pa.array(odd, pa.binary())], ["doc_id", "node", "n", *names, "odd"])

    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    marked = materialize(rows.mapInArrow(of, "doc_id long, node long, n long, " + ", ".join(f"{x} long" for x in names) + ", odd binary"), "fingerprints")
    classes = materialize(marked.groupBy("node", "n", *names, "odd").agg(F.min("doc_id").alias("doc_id")), "classes")
    slices = width * (64 // slice_bits)
    linked = None
    for propose in ("forest", "all"):
        parts = classes if linked is None else classes.join(connected_components(linked), "node", "left").withColumn("part", F.coalesce("component", "node"))
        parts = materialize(parts.select("node", *names, "n", "odd", (F.col("part") if linked is not None else F.col("node")).alias("part")), "parts")
        found, looked = [], range(min(FIRST_SLICES, slices) if propose == "forest" else slices)
        for at in range(0, len(looked), step := _slices_at_once(parts.count(), slice_bits, slice_radius)):
            found.append(materialize(near_edges(parts, width, slice_bits, slice_radius, radius, propose, threshold, PROPOSING_ROWS, slices=looked[at : at + step]), "found"))
            release_exchanges(docs.sparkSession)
        pairs = materialize(reduce(DataFrame.union, found).distinct(), "proposed")
        for part in found:
            drop_table(part)
        good = materialize(_verified(pairs, classes, rows, words, threshold), "verified")
        drop_table(pairs)
        drop_table(parts)
        release_exchanges(docs.sparkSession)
        linked = good if linked is None else linked.union(good)
    found = classes.select("node", "doc_id").join(connected_components(linked), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("root"))
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return marked.select("doc_id", "node").join(found.select("node", "root"), "node").join(least, "root").select("doc_id", "component_id")


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, one document (that with the smallest id) of each group of near-duplicates.

    Rows with a null id stay; where an id stands for several texts, its rows go
    only if each of them has to.
    """
    found = near_components(docs, id_col=id_col, text_col=text_col, **how)
    gone = found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays")).where("not stays").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
