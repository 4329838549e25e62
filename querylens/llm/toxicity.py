"""Toxicity as an ordinal grade, by cumulative-link regression (operator 3).

Grades are those of the labels, in order; the lowest means clean. One weight
for each sparse text feature is shared by all thresholds: P(grade > k) =
sigmoid(w.x - theta_k), and the expected grade is the severity. An L1 penalty
leaves only features that carry severity. The fit looks at all features: it
starts from none, and takes in those at which the penalty is too small to keep
them out, until there is none left. Labels of two grades, as those of the test
tables, teach one threshold, and severity is then the probability of toxicity.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, drop_table, held_by_worker, id_text, materialize, texts

#: The bound of the fit: about so many labelled rows, chosen by a hash of their id.
FIT_ROWS = 10_000
#: The penalty, rows that a feature must be in, and features that one look at all of them takes in.
PENALTY, LEAST_ROWS, TAKEN_IN = 2e-4, 3, 512
#: Words' beginnings that are features, besides whole words.
PREFIXES = (5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of parts of texts that a worker keeps in either half of its table.
REMEMBERED_BYTES = 24 << 20


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings."""
    digest = xxhash.xxh64_intdigest
    out = [digest("=" + word)]
    out += [digest(word[:k]) for k in PREFIXES if len(word) >= k]
    return tuple(x - 2**64 if x >= 2**63 else x for x in out)


def text_features(text: str) -> set[int]:
    """The features that stand anywhere in the whole text."""
    words = {w for part in set(text.lower().split()) for w in _WORD.findall(part)}
    return {f for w in words for f in word_features(w)}


class Model:
    """w by feature, theta ascending; grades 0 .. len(theta)."""

    def __init__(self, weights: dict[int, float], theta: np.ndarray):
        self.weights, self.theta = weights, theta
        self.name = uuid.uuid4().hex  # by which a worker knows it again

    def over(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and each threshold."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - x[:, None], -40, 40)))


def _residuals(score: np.ndarray, theta: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """For each row and threshold, P(grade > k) less whether it is."""
    p = 1 / (1 + np.exp(np.clip(theta[None] - score[:, None], -40, 40)))
    return p - (grade[:, None] > np.arange(len(theta))[None])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_cols: int, penalty: float = PENALTY, start: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Proportional-odds regression with thresholds of 1 or more, by accelerated proximal gradient: the entries (rows, cols) are 1, all others 0."""
    n, k = len(grade), int(grade.max())
    share = np.clip([(grade > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    theta, w = np.maximum(np.sort(-np.log(share / (1 - share))), 1), np.zeros(n_cols)
    if start is not None:
        w[: len(start[0])], theta = start
    v = np.ones(n_cols + 1)  # the curvature's bound, by power iteration over features and threshold
    for _ in range(20):
        v /= np.linalg.norm(v)
        s = np.bincount(rows, v[cols], n) + v[-1]
        v = np.append(np.bincount(cols, s[rows], n_cols), s.sum())
    step = 1 / (1.1 * 0.25 * k * np.linalg.norm(v) / n)
    ow, ot, t = w.copy(), theta.copy(), 1.0
    for i in range(rounds):
        r = _residuals(np.bincount(rows, w[cols], n), theta, grade) / n
        slope = np.bincount(cols, r.sum(axis=1)[rows], n_cols)
        nw = w - step * slope
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = np.maximum(np.sort(theta + step * r.sum(axis=0)), 1)
        if i % 25 == 24:  # how far the conditions of an optimum are missed
            off = np.where(w != 0, np.abs(slope + penalty * np.sign(w)), np.maximum(np.abs(slope) - penalty, 0)).max(initial=0)
            if max(off, np.abs(np.where(theta > 1, r.sum(axis=0), 0)).max()) < 0.05 * penalty:
                break
        if (w - nw) @ (nw - ow) + (theta - nt) @ (nt - ot) > 0:  # it has overshot: the momentum starts anew
            t = 1.0
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, theta = nw + (t - 1) / t2 * (nw - ow), np.sort(nt + (t - 1) / t2 * (nt - ot))
        ow, ot, t = nw, nt, t2
    return ow, ot


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = PENALTY) -> Model | None:
    """Fit on labelled rows (doc_id, toxic: the grade); None unless rows of two grades at least are there."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + (share >= 1)).collect()  # about fit_rows rows
    if not few:
        return None
    picked = docs.sparkSession.createDataFrame([(int(r["doc_id"]), int(r["toxic"])) for r in few], "doc_id long, toxic int")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                feats = [np.fromiter(f := text_features(t), np.int64, len(f)) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(feats, pa.list_(pa.int64()))], ["toxic", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("toxic", "text").mapInArrow(of, "toxic int, features array<long>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "labelled")
    found = rows.select("row", "toxic").toArrow()
    levels, grade = np.unique(found.column("toxic").to_numpy(), return_inverse=True)
    if len(levels) < 2:
        drop_table(rows)
        return None
    ids = found.column("row").to_numpy()
    place = {int(x): i for i, x in enumerate(ids)}
    seen = rows.select("row", F.explode("features").alias("f"))
    active: dict[int, int] = {}
    at, cols = np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, theta = fit_ordinal(at, cols, grade, 0, penalty)
    polished = False
    while True:
        left = _residuals(np.bincount(at, w[cols], len(grade)), theta, grade).sum(axis=1) / len(grade)
        residual = docs.sparkSession.createDataFrame(pa.table({"row": ids, "r": left}))  # as many rows as the fit has
        slopes = seen.join(F.broadcast(residual), "row").groupBy("f").agg(F.abs(F.sum("r")).alias("slope"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_ROWS) & (F.col("slope") > 1.01 * penalty))
        new = [r["f"] for r in slopes.orderBy(F.desc("slope"), "f").limit(TAKEN_IN + len(active)).collect() if r["f"] not in active]
        if not new and polished:
            break
        polished = not new  # a rough fit tells well enough which features come in; the last fit is a close one
        taken = {f: len(active) + i for i, f in enumerate(new)}
        active |= taken
        if new:
            more = docs.sparkSession.createDataFrame(list(taken.items()), "f long, col int")
            cells = seen.join(F.broadcast(more), "f").select("row", "col").toArrow()
            at = np.concatenate([at, np.array([place[x] for x in cells.column("row").to_pylist()], np.int64)])
            cols = np.concatenate([cols, cells.column("col").to_numpy().astype(np.int64)])
        w, theta = fit_ordinal(at, cols, grade, len(active), penalty, (w, theta), 6000 if polished else 400)
    drop_table(rows)
    return Model({f: float(w[i]) for f, i in active.items() if w[i]}, theta)


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    """P(grade > k) of each whole text."""
    if model is None:
        return np.zeros((len(column), 1))
    weights, score = model.weights, []

    def features(part: str) -> tuple[int, ...]:
        return tuple(x for w in _WORD.findall(part) for x in word_features(w) if x in weights)

    known = held_by_worker(("toxicity", model.name), lambda: Remembered(features, REMEMBERED_BYTES))
    for text in texts(column):
        found: set[int] = set()
        for part in set(text.lower().split()):
            if f := known[part]:
                found.update(f)
        score.append(sum(sorted(weights[x] for x in found)))
    return model.over(np.array(score, float))


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, toxic, severity, grade.

    severity is the expected grade, counted from 0 in steps of the labels'
    grades; grade the likeliest one; toxic tells whether the probability of a
    grade over the lowest reaches the threshold. The whole text counts; a null or empty one has the severity of a text without features.
    Without labels of two grades nothing is toxic and severity is 0. Labels that
    are null, repeated or of unknown documents do no harm. Extra columns are not
    read; null and repeated ids pass through.
    """
    rows = id_text(docs, id_col, text_col)
    model = fit(rows, labels)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = _scores(model, batch.column("text"))
            by_grade = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(over[:, 0] >= threshold), pa.array(over.sum(axis=1)), pa.array(by_grade.argmax(axis=1).astype(np.int32))], ["doc_id", "toxic", "severity", "grade"])

    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic boolean, severity double, grade int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that grade() does not call toxic, all columns as they are; no row is moved. Null texts count as empty, null ids stay as any row."""
    model = fit(id_text(docs, id_col, text_col), labels)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = _scores(model, batch.column(text_col))
            yield batch.filter(pa.array(over[:, 0] < threshold))

    return docs.mapInArrow(of, docs.schema)
