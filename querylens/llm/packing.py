"""Best-fit packing by a configuration linear program (operator 10).

Lengths are counted into a histogram, which has one cell for each length that
fits and so never grows. Its linear program has a variable for each way to
fill a sequence. Multiplicative weights solve it: each length's weight falls
by a factor with each share of it that is covered, and a knapsack dynamic
program finds, for each length at once, the best way to fill a sequence that
holds it at these prices. What the solution uses whole times is taken, the
rest is solved again, and the little that no whole use is left for goes by
best fit. The plan, a bounded table of intervals, then tells each piece its
sequence and offset from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import REMEMBERED_BYTES, load, tokenizer_path
from .common import drop_table, id_text, materialize, texts

#: Pieces for each count of a length that one task ranks, and pieces of a batch.
PIECES_PER_SALT, PIECES_PER_BATCH = 1_000_000, 4_096
#: Bytes of words that the encoder keeps in either half of its table where packing has the workers for itself.
REMEMBERED_ALONE = 120 << 20
#: The weights' rate, how far below the best price a configuration may stay, and the least share of a solution that another round must take.
RATE, SLACK, LEAST_SHARE = 0.1, 0.002, 0.05

Pattern = tuple[tuple[int, int], ...]  # (length, how many), the longest first


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut only if over capacity; a first piece takes what is left over."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or tokenizer_path(), remembered)
        for batch in batches:
            made: list[tuple[int, int, int, int, int]] = []

            def flushed(made=made, batch=batch) -> pa.RecordBatch:
                row, *rest = zip(*made, strict=True)
                made.clear()
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])], names)

            for i, text in enumerate(texts(batch.column("text"))):
                ids = bpe.encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                made += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                if len(made) >= PIECES_PER_BATCH:
                    yield flushed()
            if made:
                yield flushed()

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _fillings(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths at these prices: the best total for each room, and the length that it takes first (0: as with less room)."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = price[1 : room + 1] + best[room - 1 :: -1]
        i = int(value.argmax())
        if value[i] > best[room - 1]:
            best[room], first[room] = value[i], i + 1
        else:
            best[room] = best[room - 1]
    return best, first


def _configurations(sizes: np.ndarray, first: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For each size the lengths of the best configuration that holds it."""
    at = np.maximum.accumulate(np.where(first > 0, np.arange(capacity + 1), 0))
    room, live = capacity - sizes, np.arange(len(sizes))
    rows, took = [live], [sizes]
    while len(live):
        c = at[room[live]]
        live, c = live[c > 0], c[c > 0]
        rows.append(live)
        took.append(first[c])
        room[live] = c - first[c]
    rows, took = np.concatenate(rows), np.concatenate(took)
    order = np.argsort(rows, kind="stable")
    return np.split(took[order], np.searchsorted(rows[order], np.arange(1, len(sizes))))


def relaxation(need: np.ndarray, capacity: int, rate: float = RATE, slack: float = SLACK) -> tuple[dict[Pattern, float], float]:
    """A fractional plan that covers need (pieces by length) and a lower bound of any plan, by multiplicative weights.

    A length's weight starts in proportion to what it fills, a little more for
    the long ones, so that short ones are left to fill gaps. Each round prices
    the lengths by their weights, and each configuration that is worth nearly as
    much as the best is used as often as it covers no length twice. Weights fall
    with the share that is covered; a length that is covered drops out, so there
    are at most as many rounds as lengths.
    """
    length = np.arange(capacity + 1)
    left, weight, use, bound = need.astype(float), need * length * (1 + length / capacity), {}, 0.0
    while left.any():
        sizes = np.flatnonzero(left)
        price = np.full(capacity + 1, -np.inf)
        price[sizes] = weight[sizes] / need[sizes]
        best, first = _fillings(price, capacity)
        worth = price[sizes] + best[capacity - sizes]
        bound = max(bound, float(price[sizes] @ need[sizes]) / best[capacity], float(length @ need) / capacity)  # by duality, and by the room
        for size, held in reversed(list(zip(worth, _configurations(sizes, first, capacity), strict=True))):
            if size < best[capacity] * (1 - slack):
                continue
            q, k = np.unique(held, return_counts=True)
            x = float((left[q] / k).min())
            if x > 0:
                left[q] -= k * x
                left[q[left[q] < 1e-9]] = 0
                weight[q] *= np.exp(-rate * k * x / need[q])
                pattern = tuple(zip(q[::-1].tolist(), k[::-1].tolist(), strict=True))
                use[pattern] = use.get(pattern, 0.0) + x
    return use, bound


def best_fit(left: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit of decreasing lengths, a count at a time: how often each pattern is used."""
    room: dict[int, Counter[Pattern]] = {}
    for size in sorted((s for s in left if left[s] > 0), reverse=True):
        n = left[size]
        while n > 0:
            free = min((r for r in room if r >= size), default=None)
            if free is None:
                per = capacity // size
                full, rest = divmod(n, per)
                for k, times in ((per, full), (rest, 1 if rest else 0)):
                    if times:
                        room.setdefault(capacity - k * size, Counter())[((size, k),)] += times
                break
            pattern, times = next(iter(room[free].items()))
            per = min(free // size, n)
            used = min(times, n // per)
            room[free][pattern] -= used
            if not room[free][pattern]:
                del room[free][pattern]
            if not room[free]:
                del room[free]
            room.setdefault(free - per * size, Counter())[(*pattern, (size, per))] += used
            n -= used * per
    out: Counter[Pattern] = Counter()
    for patterns in room.values():
        out.update(patterns)
    return out


def plan(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """How often each pattern is used so that every piece of the histogram has a place.

    Of each fractional plan the whole uses are kept, of patterns that are filled
    as well as the plan is on average; what is left is solved again. Once whole
    uses are few, patterns are used once where their pieces are still there, the
    largest remainders first, and best fit seats the last pieces.
    """
    length, out = np.arange(capacity + 1), Counter()
    need = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        need[size] = n
    if need[capacity]:
        out[((capacity, 1),)] = int(need[capacity])
        need[capacity] = 0

    def taken(pattern: Pattern, times: float) -> int:
        n = int(min(times + 1e-9, *(need[s] // k for s, k in pattern)))
        if n:
            out[pattern] += n
            for s, k in pattern:
                need[s] -= k * n
        return n

    while need.any():
        use, _ = relaxation(need, capacity)
        whole = sum(use.values())
        fill = int(length @ need) / whole - capacity / 1024
        good = [p for p in use if sum(s * k for s, k in p) >= fill]
        done = sum(taken(p, use[p]) for p in sorted(good, key=lambda p: (-use[p], p)))
        if done < LEAST_SHARE * whole:
            sum(taken(p, 1) for p in sorted(good, key=lambda p: (-(use[p] % 1), p)))
            break
    out.update(best_fit({int(s): int(need[s]) for s in np.flatnonzero(need)}, capacity))
    return out


def intervals(patterns: Counter[Pattern]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, pieces of this length in a sequence, offset of the first)."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in sorted(patterns.items(), key=lambda x: (-x[1], x[0])):
        offset = 0
        for size, k in pattern:
            rows.append((size, used[size], sequence, k, offset))
            used[size] += k * times
            offset += size * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    All texts are packed, a null text as an empty one (its end id alone). No
    sequence holds over capacity tokens, and its pieces follow each other from
    offset 0 without a gap. Repeated rows are packed as often as they come, a
    null doc_id like any other. Extra columns are not read; an empty table gives
    an empty result. remembered is the encoder's memory of words, which changes
    the time alone.
    """
    cut = materialize(pieces(docs, capacity, end_id, path, id_col, text_col, remembered), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows = intervals(plan(histogram, capacity))
    salts = max(64, -(-sum(histogram.values()) // PIECES_PER_SALT))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(first, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).cast("long").alias("rank"))
    wide = np.int64(1) << np.int64(44)
    keys = rows[:, 0] * wide + rows[:, 1]

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            _, start, sequence, k, offset = rows[np.searchsorted(keys, length * wide + rank, "right") - 1].T
            place = rank - start
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence + place // k), pa.array(offset + place % k * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(seated, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
