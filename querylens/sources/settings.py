"""Files of NAME=value lines, and where a key or a database comes from."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the variables; each deployment sets its own values.
KEY, KEY_FILE, DATABASE = "QUERYLENS_LOG_KEY", "QUERYLENS_ENV_FILE", "QUERYLENS_LOG_DB"


def assignments(lines: DataFrame) -> DataFrame:
    """(place, name, setting) of lines (place, value): comments and lines without a = are left out.

    A quoted value ends at its closing quote, or with the line; an unquoted one
    at the first # after a blank. Of a leading ``export`` only the rest counts.
    """
    line = F.regexp_replace(F.regexp_replace("value", r"^\s+|\s+$", ""), r"^export ", "")
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    raw = F.regexp_replace(F.regexp_replace(F.col("line"), r"^[^=]*=", ""), r"^\s+|\s+$", "")
    quote = F.substring("raw", 1, 1)
    quoted = F.expr("substring_index(substring(raw, 2), substring(raw, 1, 1), 1)")
    plain = F.regexp_replace(F.regexp_replace("raw", r"(?s)\s#.*$", ""), r"^\s+|\s+$", "")
    rows = lines.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("=")).withColumn("raw", raw)
    name = F.regexp_replace(F.substring_index("line", "=", 1), r"^\s+|\s+$", "")
    return rows.select("place", name.alias("name"), F.when(quote.isin("'", '"'), quoted).otherwise(plain).alias("setting"))


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """The settings of a file; of a repeated name the last line counts."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("place", "value"))
    last = assignments(lines).groupBy("name").agg(F.max_by("setting", "place").alias("setting"))
    return {r["name"]: r["setting"] for r in last.collect()}


def resolved(spark: SparkSession, name: str, file: str | None = None) -> str:
    """A setting: of the environment, else of a file, whose own place the environment may name. Raises if there is none."""
    if found := os.environ.get(name):
        return found
    file = file or os.environ.get(KEY_FILE)
    found = read_settings(spark, file).get(name) if file else None
    if not found:
        raise KeyError(f"{name} is not set" + (f" in {file}" if file else ""))
    return found


def database_path(path: str | None = None, default: str | None = None) -> str:
    """Where the stored log is: as given, else as the environment says, else by default."""
    found = path or os.environ.get(DATABASE) or default
    if not found:
        raise KeyError(f"{DATABASE} is not set")
    return found
