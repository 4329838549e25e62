"""Language identification by error-correcting output codes (operator 4).

Each language has a codeword. For each bit a binary classifier over hashed
byte trigrams tells the languages with a 1 from those with a 0; its weights
are log-odds of trigram counts, gathered from all rows to learn from. A text's
margins are decoded to the codeword with the least weighted loss, where a bit
counts for a language as much as its classifier was right on that language. A
small lead over the next codeword marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, texts

#: Trigram cells; margins per unit of mean log-odds; least lead (in loss) of a clear decision.
CELLS_LOG2, SHARPNESS, CLEAR_LEAD = 16, 4.0, 0.5
#: At most about so many rows, of those to learn from, tell how far each bit is to be trusted.
TRUST_ROWS = 20_000
_LETTER = regex.compile(r"\p{L}")


def trigram_cells(text: str) -> np.ndarray:
    """A cell for each byte trigram of the whole text, blanks around it and case aside."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    x = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - CELLS_LOG2)


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of -1 and 1: splits of the languages into halves, of many draws the one whose codewords are the furthest apart."""
    rng, bits = np.random.default_rng(7), max(15, int(np.ceil(10 * np.log2(n))))
    halves = np.where(np.arange(n) < (n + 1) // 2, 1, -1).astype(np.int8)
    best, apart = None, -1
    for _ in range(200):
        c = rng.permuted(np.tile(halves, (bits, 1)), axis=1).T
        far = min((int((c[i] != c[:i]).sum(axis=1).min()) for i in range(1, n)), default=bits)
        if far > apart:
            best, apart = c, far
    return best


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether the row is held out: crc32 of its id as text, modulo folds."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


class Model:
    """langs, their codewords, and for each bit a weight of each cell and the trust that each language has in it."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code, weights.astype(np.float32)
        self.trust = np.full(self.code.shape, 1 / self.code.shape[1])

    def margins(self, text: str) -> np.ndarray:
        cells = trigram_cells(text)
        return SHARPNESS * self.weights[cells].mean(axis=0, dtype=np.float64)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of margins: index of the language, score, lead over the next."""
        loss = np.logaddexp(0, -self.code[None] * margins[:, None]) * self.trust[None] * self.code.shape[1]
        loss = loss.sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        first = loss.argmin(axis=1)
        two = np.sort(loss, axis=1)
        lead = two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return first, p[np.arange(len(p)), first], lead


def fit(rows: DataFrame, trust_rows: int = TRUST_ROWS) -> Model | None:
    """The model of all rows (text, lang); None if there is none with a letter and a language."""
    cells = 1 << CELLS_LOG2
    known = rows.where("text is not null and lang is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n = 0
        for batch in batches:
            for text, lang in zip(texts(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                if _LETTER.search(text):
                    if lang not in sums:
                        sums[lang] = np.zeros(cells, np.int64)
                    sums[lang] += np.bincount(trigram_cells(text), minlength=cells)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            n += len(at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "cell", "n"])

    sums = known.select("text", "lang").mapInArrow(counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "trigrams")
    total = {r["lang"]: r["n"] for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    langs = sorted(total)
    if not langs:
        return None
    where, code = {x: i for i, x in enumerate(langs)}, codewords(len(langs))
    bits = code.shape[1]
    # a cell's share of a language is (n + 1/2) / whole; only their sums over either half of a bit go to the driver
    whole = np.array([total[x] + cells / 2 for x in langs], float)
    halves = sums.sparkSession.createDataFrame([(x, 1 / float(whole[i]), (code[i] == 1).tolist()) for x, i in where.items()], "lang string, scale double, ones array<boolean>")
    part = F.col("n") * F.col("scale")
    got = sums.join(halves, "lang").groupBy("cell").agg(F.sum(part).alias("all"), *(F.sum(F.when(F.col("ones")[b], part).otherwise(0.0)).alias(f"b{b}") for b in range(bits))).toArrow()
    at = got.column("cell").to_numpy()
    every, one = np.full(cells, (0.5 / whole).sum()), np.tile((0.5 / whole) @ (code == 1), (cells, 1))
    every[at] += got.column("all").to_numpy()
    for b in range(bits):
        one[at, b] += got.column(f"b{b}").to_numpy()
    of_one, of_zero = (code == 1).sum(axis=0), (code == -1).sum(axis=0)
    weights = np.log((one / of_one) / ((every[:, None] - one) / of_zero)) if len(langs) > 1 else np.zeros((cells, bits))
    model = Model(langs, code, weights)
    drop_table(sums)
    share = min(1.0, trust_rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + (share >= 1)).select("text", "lang")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros((*model.code.shape, 2), np.int64)
        for batch in batches:
            for text, lang in zip(texts(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                if _LETTER.search(text):
                    ok = model.code[where[lang]] * model.margins(text) > 0
                    right[where[lang], np.arange(len(ok)), 0] += ok
                    right[where[lang], :, 1] += 1
        lang, bit = np.indices(model.code.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lang, bit, right[..., 0].ravel(), right[..., 1].ravel())], ["lang", "bit", "ok", "n"])

    for r in some.mapInArrow(judged, "lang long, bit long, ok long, n long").groupBy("lang", "bit").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect():
        model.trust[r["lang"], r["bit"]] = (r["ok"] + 1) / (r["n"] + 2)
    model.trust /= model.trust.sum(axis=1, keepdims=True)
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, ambiguous.

    Learns only from rows that are not held out and have a language; a
    prediction reads the whole text and nothing else. lang_pred is ``und``, with
    score 0, for a null text, one without a letter, and where there is nothing
    to learn from. A null doc_id is not held out and not learnt from. Repeated
    rows each have a row; extra columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", in_fold(F.col("doc_id")))
    model = fit(rows.where("not held_out and doc_id is not null"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            there, margins = [], []
            for i, t in enumerate(texts(batch.column("text")) if model else ()):
                if _LETTER.search(t):
                    there.append(i)
                    margins.append(model.margins(t))
            lang, score, lead = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            if there:
                first, p, gap = model.decode(np.stack(margins))
                lang[there], score[there], lead[there] = [model.langs[k] for k in first], p, gap
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(lead < CLEAR_LEAD)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    out = rows.select("doc_id", "held_out", "text")
    return out.mapInArrow(of, f"doc_id {out.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")
