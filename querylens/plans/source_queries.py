"""Queries over sources: payloads, encrypted rows, validation, corpus checks."""

from __future__ import annotations

import json
import os
import sqlite3

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import gate
from ..shared import new_folder
from ..sources import export, files, judgments, log, settings
from ..streaming import daily
from . import views

#: A key for round trips, of no secret.
KEY = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="


@query("select event_id, cast(props->>'$.k' as bigint) as k, json_type(props, '$.k') in ('BIGINT', 'UBIGINT') as is_integer from events")
def payload_scan(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").withColumn("v", F.expr("try_parse_json(props)"))
    return e.select("event_id", F.expr("try_variant_get(v, '$.k', 'bigint')").alias("k"), F.expr("schema_of_variant(try_variant_get(v, '$.k', 'variant')) = 'BIGINT'").alias("is_integer"))


def _stored(spark, sf_dir):
    """The log as it is stored: payloads encrypted, some signed with another key, some of a wrong shape."""
    rows = views.log(spark, sf_dir).withColumn("payload", F.expr("case when row_id % 11 = 0 then '[1]' when row_id % 13 = 0 then '{\"q\": 7}' else to_json(named_struct('q', query, 'pkg', packages)) end"))
    rows = rows.withColumn("iv", F.expr("unhex(substr(md5(cast(row_id as string)), 1, 32))")).withColumn("token", log.encrypted("payload", KEY, "iv"))
    return rows.select(F.col("row_id").alias("id"), F.expr("if(row_id % 17 = 0, concat(token, 'A'), token)").alias("encrypted_query_data"), "source", "result_count", "collected_on")


_LOADED = "row_id % 11 <> 0 and row_id % 13 <> 0 and row_id % 17 <> 0"


@query(f"with {views.LOG} select row_id, query, array_to_string(packages, ',') as packages, source, result_count from log where {_LOADED} and collected_on >= date '2024-01-03'")
def encrypted_log_scan(spark, sf_dir):
    rows = log.load_log(_stored(spark, sf_dir), KEY, since="2024-01-03")[0]
    return rows.select("row_id", "query", F.array_join("packages", ",").alias("packages"), "source", "result_count")


@query(f"with {views.LOG} select count(*) as rows_read, count(*) filter (where {_LOADED}) as rows_loaded, count(*) filter (where not ({_LOADED})) as rows_undecryptable from log")
def encrypted_log_report(spark, sf_dir):
    return log.load_log(_stored(spark, sf_dir), KEY)[1]


@query("select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n from events group by all")
def streaming_daily_volume(spark, sf_dir):
    """The batch run of the streaming plan; a watermark has no effect in batch."""
    return daily.daily_volume(views.table(spark, sf_dir, "events")).withColumn("day", F.col("day").cast("string"))


def _file(spark, label: str, text: str) -> str:
    """A file in the shared folder that holds a text; its path."""
    path = new_folder(spark, label)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query("select s_suppkey as id, s_name as query, case when s_suppkey % 2 = 0 then 'web' else 'api' end as source, s_nationkey as result_count, cast(date '2024-01-01' + cast(s_suppkey % 9 as integer) as varchar) as collected_on from supplier where s_suppkey % 9 >= 2 and s_suppkey % 17 <> 0")
def sqlite_log_scan(spark, sf_dir):
    """The suppliers as a stored log: a SQLite file, read by ranges of ids with the date pushed into it, decrypted and parsed."""
    rows = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("if(s_suppkey % 2 = 0, 'web', 'api')").alias("source"), F.col("s_nationkey").cast("int").alias("n"), F.expr("cast(date_add(date'2024-01-01', cast(s_suppkey % 9 as int)) as string)").alias("day"), F.expr("to_json(named_struct('q', s_name, 'pkg', array('p')))").alias("payload"))
    rows = rows.withColumn("iv", F.expr("unhex(md5(cast(id as string)))")).withColumn("token", log.encrypted("payload", KEY, "iv")).withColumn("token", F.expr("if(id % 17 = 0, concat('A', token), token)"))
    folder = new_folder(spark, "sqlite").removeprefix("file://")
    os.makedirs(folder)
    with sqlite3.connect(f"{folder}/log.db") as c:  # the fixture, which is small
        c.execute(f"create table {log.TABLE} (id integer primary key, encrypted_query_data text, source text, result_count integer, collected_on text)")
        c.executemany(f"insert into {log.TABLE} values (?, ?, ?, ?, ?)", [(r["id"], r["token"], r["source"], r["n"], r["day"]) for r in rows.collect()])
    stored = log.read_sqlite(spark, f"{folder}/log.db", since="2024-01-03")
    return log.load_log(stored, KEY, since="2024-01-03")[0].select(F.col("row_id").alias("id"), "query", "source", "result_count", F.col("collected_on").cast("string").alias("collected_on"))


def _records(spark, sf_dir) -> list[dict]:
    return [r.asDict() for r in views.table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]


@query("""with b as (select *, item_id % 4 as s, row_number() over (partition by item_id % 4 order by item_id) as place from benchmark), n as (select s, count(*) as n from b group by s)
    select place + coalesce((select sum(n) from n where n.s < b.s), 0)::bigint as position, ['web', 'web_account', 'api', 'mcp'][s + 1] as source, text, case when item_id % 3 = 0 then null else item_id end as result_count, cast(date '2024-02-01' + cast(item_id % 5 as integer) as varchar) as day
    from b where item_id % 5 >= 1""")
def json_export_scan(spark, sf_dir):
    """The benchmark's items as a JSON export: one object, a list for each source; positions count all records, before the date filter."""
    out: dict = {s: [] for s in export.SOURCES}
    for r in _records(spark, sf_dir):
        i = r["item_id"]
        out[export.SOURCES[i % 4]].append({"query": r["text"], "package_filters": ["p"] if i % 2 else [], "result_count": None if i % 3 == 0 else i, "collected_on": f"2024-02-{1 + i % 5:02d}"})
    rows = export.load_export(spark, _file(spark, "export", json.dumps(out)), since="2024-02-02")
    return rows.select("position", "source", "text", "result_count", F.col("day").cast("string").alias("day"))


@query("""with b as (select *, ['web', 'web_account', 'api', 'mcp'][item_id % 4 + 1] as source, row_number() over (partition by item_id % 4 order by item_id) as place from benchmark)
    select source, place, item_id % 7 not in (1, 2, 3, 4) as valid from b""")
def export_validators(spark, sf_dir):
    """Which records of an export are valid; those of four kinds are broken on purpose."""
    out: dict = {s: [] for s in export.SOURCES}
    for r in _records(spark, sf_dir):
        i = r["item_id"]
        record = {"query": r["text"], "package_filters": ["p"], "result_count": i, "collected_on": "2024-02-03"}
        record |= {1: {"query": 7}, 2: {"package_filters": [""]}, 3: {"result_count": -1}, 4: {"collected_on": "2024-02-30"}}.get(i % 7, {})
        out[export.SOURCES[i % 4]].append(record)
    rows = spark.createDataFrame([(json.dumps(out),)], "value string")
    return export.records(rows).select("source", F.col("place").cast("long").alias("place"), "valid")


def _collection(spark, sf_dir) -> dict:
    items = _records(spark, sf_dir)
    return {"corpus_revision": "r1", "queries": [{"id": f"q{r['item_id']}", "group_id": f"g{r['item_id'] % 5}", "track": "human" if r["item_id"] % 2 else "agent", "answerability": "answerable", "judgments": {f"d{r['item_id'] + j}": j for j in range(4)}, "premise_routes": [[[f"d{r['item_id'] + 2}", f"d{r['item_id'] + 3}"], [f"d{r['item_id'] + 3}"]]]} for r in items]}


def _run(spark, sf_dir) -> dict:
    return {"name": "a run", "corpus_revision": "r1", "max_k": 10, "results": {f"q{r['item_id']}": {"status": "ok", "documents": [f"d{r['item_id'] + j}" for j in (5, 3, 2)], "latency_ms": 1.5 * r["item_id"]} for r in _records(spark, sf_dir) if r["item_id"] % 6}}


@query("with j as (select unnest([0, 1, 2, 3]) as j) select 'q' || item_id as q, 'd' || (item_id + j) as doc, j as grade, case when item_id % 2 = 1 then 'human' else 'agent' end as track, 'g' || (item_id % 5) as group_id from benchmark, j")
def collection_reader(spark, sf_dir):
    """A relevance collection in JSON, as long tables joined again."""
    queries, qrels, _ = judgments.read_collection(spark, _file(spark, "collection", json.dumps(_collection(spark, sf_dir))))
    return qrels.join(queries, "q").select("q", "doc", "grade", "track", "group_id")


@query("select 'q' || item_id as q, 0 as route, unnest([0, 0, 1]) as grp, unnest(['d' || (item_id + 2), 'd' || (item_id + 3), 'd' || (item_id + 3)]) as doc from benchmark")
def route_reader(spark, sf_dir):
    """The premise routes of a collection, a row for each document of each group."""
    return judgments.read_collection(spark, _file(spark, "collection", json.dumps(_collection(spark, sf_dir))))[2]


@query("select 'q' || item_id as q, unnest(['d' || (item_id + 5), 'd' || (item_id + 3), 'd' || (item_id + 2)]) as doc, unnest([1, 2, 3])::bigint as rank, 1.5 * item_id as latency_ms from benchmark where item_id % 6 <> 0")
def run_reader(spark, sf_dir):
    """A ranked run in JSON, as long tables joined again."""
    results, ranking = judgments.read_run(spark, _file(spark, "run", json.dumps(_run(spark, sf_dir))))
    return ranking.join(results, "q").select("q", "doc", "rank", "latency_ms")


@query("select 'q' || item_id as id, text as query, 'c' || (item_id % 3) as category, 1::bigint as targets from benchmark")
def pilot_reader(spark, sf_dir):
    """Pilot queries in JSON, validated."""
    rows = [{"id": f"q{r['item_id']}", "query": r["text"], "category": f"c{r['item_id'] % 3}", "relevant": ["a name"], "packages": []} for r in _records(spark, sf_dir)]
    return judgments.read_pilot(spark, _file(spark, "pilot", json.dumps(rows))).select("id", "query", "category", F.size("relevant").cast("long").alias("targets"))


@query("select r_regionkey as region, octet_length(encode(r_name || ':' || r_regionkey))::bigint + 1 as bytes, sha256(r_name || ':' || r_regionkey || chr(10)) as sha256 from region")
def file_fingerprints(spark, sf_dir):
    """Sizes and digests of files below a folder, one for each region."""
    path = new_folder(spark, "files")
    rows = views.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.expr("concat(r_name, ':', r_regionkey)").alias("value"))
    rows.repartition(1).sortWithinPartitions("region").write.partitionBy("region").text(path)
    return files.fingerprints(spark, path).where("path like '%part-%'").select(F.regexp_extract("path", r"region=(\d+)", 1).cast("int").alias("region"), "bytes", "sha256")


@query("""select r_regionkey as region, sha256('{"k": ' || r_regionkey || ', "name": "' || r_name || '"}') as sha256 from region""")
def content_hashes(spark, sf_dir):
    """Digests of JSON files by content: the files differ from the canonical form in order and blanks."""
    path = new_folder(spark, "json")
    value = F.concat(F.lit('{ "name" :\n"'), "r_name", F.lit('","k":  '), F.col("r_regionkey").cast("string"), F.lit("}"))
    rows = views.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), value.alias("value"))
    rows.repartition(1).sortWithinPartitions("region").write.partitionBy("region").text(path)
    return files.canonical_hashes(spark, path).select(F.regexp_extract("path", r"region=(\d+)", 1).cast("int").alias("region"), "sha256")


_GATED = f"with {views.REQUESTS}, c as (select source, day, count(*) as n from requests group by all), w as (select *, row_number() over (order by n, source, day) as r, sum(case when n < 10 then 1 else 0 end) over () as sm, count(*) over () as g from c), f as (select *, n < 10 or (sm = 1 and g > 2 and r = 2) as hid from w), released as (select cast(source as varchar) as source, cast(day as varchar) as day, cast(floor((n + 5) / 10.0) * 10 as bigint) as n from f where not hid union all select '<suppressed>', '<suppressed>', case when sum(n) >= 10 then cast(floor((sum(n) + 5) / 10.0) * 10 as bigint) end from f where hid having count(*) > 0)"


@query(_GATED + " select source, day, cast(n as varchar) as n from released")
def csv_sink(spark, sf_dir):
    """A gated table written as CSV, and what a reader finds in it."""
    path = new_folder(spark, "csv")
    files.write_csv(gate.releasable_counts(views.requests(spark, sf_dir), ["source", "day"]), path, ["source", "day"])
    return spark.read.option("header", "true").csv(path)


@query(_GATED + " select source || '/' || day as measure, n as count from released")
def flat_summary(spark, sf_dir):
    """A gated table as paths and counts."""
    return files.flat(gate.releasable_counts(views.requests(spark, sf_dir), ["source", "day"]), ["source", "day"], "n")


@query(_GATED + " select source, day, n from released where n is not null")
def json_sink(spark, sf_dir):
    """A gated table written as nested JSON, and what a reader finds in it."""
    nested = files.nested(gate.releasable_counts(views.requests(spark, sf_dir), ["source", "day"]), ["source", "day"], "n")
    read = spark.read.schema("value string").text(_file(spark, "counts", json.dumps(nested)), wholetext=True)
    rows = read.select(F.explode(F.from_json("value", "map<string, map<string, bigint>>")).alias("source", "days")).select("source", F.explode("days").alias("day", "n"))
    return rows.where("n is not null")


@query("""with l as (select unnest(['plain', 'single', 'double', 'open', 'comment', 'hash', 'export']) as kind) select kind || '_' || r_regionkey as name, case kind when 'plain' then r_name when 'single' then 'a # b' when 'double' then 'c' when 'open' then 'd' when 'comment' then 'e' when 'hash' then 'f#g' else r_name end as setting from region, l""")
def dotenv_settings(spark, sf_dir):
    """Lines of NAME=value in all the forms that are allowed, and others that are not."""
    lines = F.expr("""array(concat(' plain_', k, ' = ', r_name, ' '), concat('single_', k, "='a # b' # c"), concat('double_', k, '="c"d'), concat('open_', k, '="d '), concat('comment_', k, '=e # f'), concat('hash_', k, '=f#g'), concat('export export_', k, '=', r_name), '# no', 'none', '')""")
    rows = views.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name").select(F.posexplode(lines).alias("place", "value"))
    return settings.assignments(rows).select("name", "setting")
