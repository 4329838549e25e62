"""Secret scans through a trigram inverted index (operator 6).

From each rule's regular expression a Boolean query over trigrams is derived
that any matching text must satisfy. A segment of texts is indexed by the
trigrams that the rules ask for; intersecting and uniting their postings
leaves candidates, and only these are searched. A rule without a mandatory
trigram scans all texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, texts

#: Bytes of text of a segment (a longer text is a segment of its own); most strings that a part of a rule is spelt out to.
SEGMENT_BYTES, MOST_SPELT = 2 << 20, 64

Query = bool | str | tuple  # True: no trigram is mandatory; a trigram; ("and" | "or", queries)


@dataclass(frozen=True)
class Rule:
    """A match counts if its group is of least characters at least; groups that are too short use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules, in order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),  # all maximal runs of 24 and more, so the same as [0-9a-f]+ with the short ones dropped
)
#: What the index makes cheap to look for besides.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("ghp", r"gh[pousr]_[A-Za-z0-9]+", least=40),
)


def _both(queries: list[Query]) -> Query:
    queries = [q for q in dict.fromkeys(queries) if q is not True]
    return True if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def _either(queries: list[Query]) -> Query:
    queries = list(dict.fromkeys(queries))
    return True if True in queries else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _spelt(strings: set[str]) -> Query:
    return _either([_both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, Query]:
    """Of a sequence: the lower-case strings that it can match, if they are few, and what they must contain."""
    exact: set[str] | None = {""}
    run, must = {""}, []
    for op, arg in items:
        name = str(op)
        strings: set[str] | None = None
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            ranges = [(a, a) if str(o) == "LITERAL" else a for o, a in arg]
            if all(high - low < MOST_SPELT for low, high in ranges):  # a wider class is not spelt out
                strings = {chr(c).lower() for low, high in ranges for c in range(low, high + 1)}
        elif name == "SUBPATTERN":
            strings, inner = _walk(arg[-1])
            must.append(inner)
        elif name == "BRANCH":
            ways = [_walk(x) for x in arg[1]]
            must.append(_either([q for _, q in ways]))
            strings = set().union(*(s for s, _ in ways)) if all(s is not None for s, _ in ways) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            once, query = _walk(inner)
            if low:
                must.append(query)
            if (low, high) in ((0, 1), (1, 1)) and once is not None:
                strings = once | ({""} if low == 0 else set())
        elif name == "AT":
            strings = {""}
        joined = {a + b for a in run for b in strings} if strings is not None and len(run) * len(strings) <= MOST_SPELT else None
        if joined is None:
            must.append(_spelt(run))
            run, exact = (strings if strings is not None and len(strings) <= MOST_SPELT else {""}), None
        else:
            run = joined
    must.append(_spelt(run))
    return (run if exact is not None else None), _both(must)


def trigram_query(rule: Rule) -> Query:
    """The Boolean trigram query that every text with a match satisfies, over lower-case text."""
    return _walk(parser.parse(rule.pattern))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


class SegmentIndex:
    """Postings of the asked trigrams over one segment of texts."""

    def __init__(self, raw: list[bytes], table: np.ndarray, wanted: list[str]):
        low = b"\0\0".join(raw).lower() + b"\0\0"
        ends = np.cumsum([len(t) + 2 for t in raw])
        self.size = len(raw)
        docs, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for start in range(0, len(low) - 2, SEGMENT_BYTES):  # a long text takes no more memory at a time than a short segment
            part = np.frombuffer(low, np.uint8, min(SEGMENT_BYTES + 2, len(low) - start), start).astype(np.uint32)
            number = table[part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]]
            at = np.flatnonzero(number)
            docs.append(np.searchsorted(ends, at + start, "right"))
            numbers.append(number[at])
        doc, number = np.concatenate(docs), np.concatenate(numbers)
        self.postings = {t: np.unique(doc[number == i + 1]) for i, t in enumerate(wanted)}

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        sets = [self.candidates(q) for q in query[1]]
        out = sets[0]
        for s in sets[1:]:
            out = np.intersect1d(out, s, assume_unique=True) if query[0] == "and" else np.union1d(out, s)
        return out


def _letters(strings: set[str]) -> list[str]:
    if len(strings) > 255:
        raise ValueError("an index holds the postings of 255 trigrams at most; scan with fewer rules at a time")
    return sorted(strings)


def _segments(every: Iterator[str]) -> Iterator[list[tuple[str, bytes]]]:
    """Texts with their bytes, as many as make a segment; only one segment is held."""
    held, size = [], 0
    for t in every:
        raw = t.encode("utf-8", "replace")
        if held and size + len(raw) > SEGMENT_BYTES:
            yield held
            held, size = [], 0
        held.append((t, raw))
        size += len(raw)
    if held:
        yield held


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_<kind> for each base rule, base_sha256, spans.

    spans lists kind:start:end of all rules' matches, by start and then by the
    order of the rules, in code points, end exclusive, comma-joined; base_sha256
    digests the base rules' share of it. A null text counts as empty: no span.
    Ids may be null or repeat; extra columns are not read.
    """
    queries = [trigram_query(r) for r in rules]
    wanted = _letters({t for q in queries for t in trigrams(q) if t.isascii()})
    names = [f"n_{r.kind}" for r in base]
    is_base = {r.kind for r in base}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 24, np.uint8)
        for i, t in enumerate(wanted):
            table[ord(t[0]) << 16 | ord(t[1]) << 8 | ord(t[2])] = i + 1
        compiled = [r.compiled() for r in rules]
        for batch in batches:
            found: list[list[tuple[int, int, int]]] = []
            for segment in _segments(texts(batch.column("text"))):
                index, here = SegmentIndex([raw for _, raw in segment], table, wanted), [[] for _ in segment]
                for k, (rule, query, pattern) in enumerate(zip(rules, queries, compiled, strict=True)):
                    for i in index.candidates(query):
                        for m in pattern.finditer(segment[i][0]):
                            if len(m.group(rule.group)) >= rule.least:
                                here[i].append((m.start(), k, m.end()))
                found += here
            counts = [[sum(rules[k].kind == r.kind for _, k, _ in f) for f in found] for r in base]
            spans = [[(rules[k].kind, f"{rules[k].kind}:{s}:{e}") for s, k, e in sorted(f)] for f in found]
            sha = [hashlib.sha256(",".join(x for kind, x in f if kind in is_base).encode()).hexdigest() for f in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([",".join(x for _, x in f) for f in spans], pa.string())], ["doc_id", *names, "base_sha256", "spans"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string")
