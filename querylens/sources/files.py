"""Fingerprints of files, and the sinks of gated tables: CSV, flat and nested JSON, a manifest, a page."""

from __future__ import annotations

import fnmatch
import hashlib
import html
import json
import pathlib
import platform

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def flat(df: DataFrame, path: list[str], count: str = "count") -> DataFrame:
    """(measure, count): the path columns joined by strokes."""
    return df.select(F.concat_ws("/", *path).alias("measure"), F.col(count).alias("count"))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A gated table, which is small, as one CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", "true").csv(path)


def nested(df: DataFrame, path: list[str], count: str = "count") -> dict:
    """A gated table as nested dicts."""
    out: dict = {}
    for r in df.select(*path, count).collect():
        at = out
        for p in path[:-1]:
            at = at.setdefault(r[p], {})
        at[r[path[-1]]] = r[count]
    return out


def canonical_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of JSON files by their content: keys sorted, ASCII alone, the usual separators; null for what is no JSON."""

    @pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                return hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, ensure_ascii=True).encode()).hexdigest()
            except ValueError:
                return None

        return texts.map(one)

    # not input_file_name(): Python reads ahead, and it then names a later file of the same task
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), digest("value").alias("sha256"))


def as_json(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def manifest(spark: SparkSession, source: str, **settings) -> str:
    """JSON: the input's fingerprints, those of this package's modules, versions, and the settings of a report."""
    from .. import __file__ as package

    files = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in fingerprints(spark, source).collect()}
    own = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(pathlib.Path(package).parent.rglob("*.py"))}
    fixed = {"normalization": "NFC_whitespace_case_preserving", "intent_and_domain": "unvalidated_rule_cues", "actor_identity": "unknown_for_all_rows", "retrieval_evaluated": False}
    return as_json({"spark": spark.version, "python": platform.python_version(), "input_sha256": files, "source_sha256": own, **fixed, **settings})


def write_new(path: str, text: str) -> None:
    """A file that must not be there yet."""
    with open(path, "x", encoding="utf-8", newline="\n") as f:
        f.write(text)


def experiment_report(spark: SparkSession, records: DataFrame, summary: DataFrame, path: str, **arguments) -> None:
    """A run's arguments, versions, records and summary as one JSON file; an existing one is never overwritten."""
    rows = {n: [r.asDict(recursive=True) for r in df.orderBy(*df.columns).collect()] for n, df in (("records", records), ("summary", summary))}
    write_new(path, as_json({"schema_version": 1, "spark": spark.version, "python": platform.python_version(), "arguments": arguments, **rows}))


def problems_of_publication(paths: list[str], allowed: dict[str, str | None]) -> list[str]:
    """What keeps files from being published: paths off the list (patterns -> a fixed hash or None), and changed contents."""
    out = []
    for p in paths:
        rule = next((a for a in allowed if fnmatch.fnmatch(p, a)), None)
        if rule is None:
            out.append(f"not allowed: {p}")
        elif allowed[rule] is not None and hashlib.sha256(pathlib.Path(p).read_bytes()).hexdigest() != allowed[rule]:
            out.append(f"changed: {p}")
    return out


def cell(v: object) -> str:
    """A cell as text: shares as percentages, whole numbers with commas, nothing for null."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    return f"{v:.2%}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v)


def page(sections: dict[str, DataFrame]) -> str:
    """Gated tables as one self-contained HTML page; every cell is escaped."""
    parts = []
    for title, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        parts.append(f"<h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    return "<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>Query log</title></head><body>" + "".join(parts) + "</body></html>\n"
