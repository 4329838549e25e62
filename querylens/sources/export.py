"""The JSON export: one object, a list of records for each source; every record is validated before any is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The sources, in order.
SOURCES = ("web", "web_account", "api", "mcp")

_TYPE = "coalesce(schema_of_variant(try_variant_get(value, '$.{}', 'variant')), 'missing')".format
_VALID = f"""{_TYPE('query')} = 'STRING' and {_TYPE('package_filters')} like 'ARRAY<%'
    and ({_TYPE('package_filters')} in ('ARRAY<STRING>', 'ARRAY<VOID>') and coalesce(forall(packages, p -> length(p) > 0), true))
    and ({_TYPE('result_count')} = 'VOID' or {_TYPE('result_count')} in ('BIGINT') and result_count >= 0)
    and {_TYPE('collected_on')} = 'STRING' and day is not null and date_format(day, 'yyyy-MM-dd') = day_text"""


def records(texts: DataFrame) -> DataFrame:
    """(source, place, text, packages, result_count, day, valid) of texts (value), each an export's JSON.

    The whole of an export is one JSON value, so one task reads it; its records
    are exploded and go on in parallel.
    """
    root = texts.select(F.expr("try_parse_json(value)").alias("root")).where("root is not null")
    lists = root.select(F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.expr(f"try_variant_get(root, '$.{s}', 'array<variant>')").alias("rows")) for s in SOURCES))).alias("x")).select("x.source", F.posexplode("x.rows").alias("place", "value"))
    typed = lists.select(
        "source", (F.col("place") + 1).alias("place"), "value", F.expr("try_variant_get(value, '$.query', 'string')").alias("text"), F.expr("try_variant_get(value, '$.package_filters', 'array<string>')").alias("packages"),
        F.expr("try_variant_get(value, '$.result_count', 'bigint')").alias("result_count"), F.expr("try_variant_get(value, '$.collected_on', 'string')").alias("day_text"),
    ).withColumn("day", F.expr("try_to_date(day_text, 'yyyy-MM-dd')"))
    return typed.withColumn("valid", F.coalesce(F.expr(_VALID), F.lit(False))).drop("value", "day_text")


def load_export(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """position, source, text, packages, result_count, day. Raises, by position only, if any record is bad, left out or not."""
    texts = spark.read.text(path, wholetext=True)
    known = ", ".join(f"'{s}'" for s in SOURCES)
    shape = texts.select(F.expr("try_parse_json(value)").alias("r")).select(F.expr("schema_of_variant(r) like 'OBJECT<%'").alias("object"), F.expr(f"size(array_except(json_object_keys(to_json(r)), array({known}))) = 0").alias("known"), *(F.expr(f"coalesce(schema_of_variant(try_variant_get(r, '$.{s}', 'variant')), 'ARRAY<') like 'ARRAY<%'").alias(f"list_{s}") for s in SOURCES))
    if not shape.where(" and ".join(f"coalesce({c}, false)" for c in shape.columns)).count() == shape.count() > 0:
        raise ValueError("expected an object of lists keyed only by known sources")
    every = records(texts)
    bad = every.where("not valid").orderBy(F.expr(f"array_position(array({known}), source)"), "place").select("source", "place").first()
    if bad:
        raise ValueError(f"invalid record at source {bad['source']}, position {bad['place']}")
    before = every.groupBy("source").agg(F.max("place").alias("n")).withColumn("o", F.expr(f"array_position(array({known}), source)"))
    start = before.select("source", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    out = every.join(F.broadcast(start), "source").select((F.col("start") + F.col("place")).alias("position"), "source", "text", "packages", "result_count", "day")
    return out if since is None else out.where(F.col("day") >= F.lit(since).cast("date"))
