"""BPE encoding by backtracking over longest matches, decoding by offsets (operator 5).

An Aho-Corasick automaton over the vocabulary gives the longest token at each
place of a word. Tokens are taken from the left; one may follow another only
if the pair-compatibility table says that merging would leave their border
alone. Where no shorter prefix fits either, the last token is taken back. Each
place is tried once, so time is linear, and the result equals that of merging
in rank order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Remembered, held_by_worker, id_text, texts

#: Fixed value: the word pattern of byte-level BPE vocabularies, with Unicode's White_Space written out.
SPACE = r"[\t-\r \x85\xa0  -     　]"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{SPACE})[^\p{{L}}\p{{N}}])+|{SPACE}+(?!(?!{SPACE})[\s\S])|{SPACE}+"
#: White space other than a single blank or line feed between words.
_UNUSUAL = ["  ", " \n", "\n ", "\n\n", *map(chr, (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
#: Bytes of words that a worker keeps in either half of a table, and pairs whose fit it keeps; beyond, these start anew.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 40 << 20, 200_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if visible, else the next free one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbol = spec["model"]["vocab"], byte_symbols()
        raw = {t: bytes(symbol[c] for c in t) for t in vocab}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # inside, tokens are numbered in merge order: single bytes first, then one for each merge
        made = {a + b for a, b in pairs}
        order = [t for t in vocab if t not in made] + [a + b for a, b in pairs]
        number = {t: i for i, t in enumerate(order)}
        self.ids = [vocab[t].to_bytes(4, "little") for t in order]
        self.text = [raw[t].decode("latin-1") for t in order]
        base = len(order) - len(pairs)
        self.split = [(i, i) for i in range(base)] + [(number[a], number[b]) for a, b in pairs]
        self.pair = {(number[a], number[b]): base + i for i, (a, b) in enumerate(pairs)}
        known = {s: i for i, s in enumerate(self.text)}
        self.shorter = [next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1) for s in self.text]
        self.size = [len(s) for s in self.text]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, s in enumerate(self.text):
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.find = regex.compile(WORD).findall
        self.fits: dict[int, bool] = {}
        self.word = Remembered(self._word, remembered // 8)
        self.blank = Remembered(self._after_blank, remembered)
        # offset table: token id -> its place in one string of all tokens' bytes
        by_id = {vocab[t]: raw[t] for t in vocab} | {i: s.encode() for s, i in self.special.items()}
        self.at = np.zeros(max(by_id) + 2, np.int64)
        for i, s in by_id.items():
            self.at[i + 1] = len(s)
        self.at = np.cumsum(self.at)
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(max(by_id) + 1)), np.uint8)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging in rank order would leave the border between the two tokens alone."""
        split, pair, limit = self.split, self.pair, len(self.split)
        x, y = a, b
        while True:
            if pair.get((x, y), limit) < limit:
                return False
            if x > y:
                limit, x = x, split[x][1]
                if x == limit:  # a single byte: go on at the other side
                    limit, y = y + 1, split[y][0]
                    if y + 1 == limit:
                        return True
            else:
                limit, y = y + 1, split[y][0]
                if y + 1 == limit:
                    limit, x = x, split[x][1]
                    if x == limit:
                        return True

    def tokens(self, s: str) -> list[int]:
        """The tokens, numbered in merge order, of a word given as one character a byte."""
        n, size, shorter, fits, longest = len(s), self.size, self.shorter, self.fits, self.automaton.iter_long
        out: list[int] = []
        dead: set[int] = set()  # places from which the rest has no valid tokens
        at, last, matches = 0, -1, longest(s)
        while at < n:
            t = first = next(matches)[1]  # every byte is a token, so the next match begins here
            while True:
                end = at + size[t]
                if last < 0:
                    ok = True
                elif (ok := fits.get(last << 20 | t)) is None:
                    if len(fits) >= REMEMBERED_PAIRS:
                        fits.clear()
                    ok = fits[last << 20 | t] = self._compatible(last, t)
                if ok and end not in dead:
                    break
                t = shorter[t]
                while t < 0:  # nothing fits here: the token before is taken back
                    dead.add(at)
                    t = out.pop()
                    at -= size[t]
                    t = shorter[t]
                    last, first = out[-1] if out else -1, -1
            out.append(t)
            at, last = end, t
            if t != first:
                matches = longest(s, at)
        return out

    def _word(self, word: str) -> bytes:
        ids = self.ids
        return b"".join([ids[t] for t in self.tokens(word if word.isascii() else word.encode("utf-8").decode("latin-1"))])

    def _after_blank(self, part: str) -> bytes:
        """Of what stands between two blanks, with the first of them."""
        if part.isalpha():
            return self._word(" " + part)
        if part[-1:] in (",", ".") and part[:-1].isalpha():
            return self.blank[part[:-1]] + self.word[part[-1]]
        word = self.word
        return b"".join([word[w] for w in self.find(" " + part)])

    def _piece(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _UNUSUAL):
            return b"".join(map(self.word.__getitem__, self.find(text)))
        # a word takes the blank before it and never one after it: cut there
        lines = []
        word, feed, blank = self.word, self.word["\n"], self.blank.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(b"".join([*(word[w] for w in self.find(first)), *map(blank, rest)]))
        return feed.join(lines)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; special tokens only where their strings stand in the text."""
        if not self.special or not any(s in text for s in self.special):
            return self._piece(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._piece(x) for x in self.parts.split(text))

    def decode(self, ids: bytes) -> str:
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        start, size = self.at[i], self.at[i + 1] - self.at[i]
        place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.bytes[place].tobytes().decode("utf-8", "replace")


def load(path: str, remembered: int = REMEMBERED_BYTES) -> Bpe:
    """The encoder of a file, once for each worker process, with so many bytes of words in either half of its table."""
    return held_by_worker(("bpe", path, remembered), lambda: Bpe(path, remembered))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the whole text's tokens; a null text counts as empty and has none."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or tokenizer_path())
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t), "<i4") for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give an empty text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or tokenizer_path())
        for batch in batches:
            text = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The whole text is encoded and its ids are decoded again. A null text counts
    as empty: no tokens, the digests of nothing. Null and repeated ids pass
    through; extra columns are not read; an empty table gives an empty result.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or tokenizer_path())
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in texts(batch.column("text")):
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
