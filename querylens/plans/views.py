"""The test tables seen as a query log, as requests, as chat, as ranked runs and as a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, query, packages, source, result_count, collected_on of documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("query"), F.expr("if(lang = 'en', cast(array() as array<string>), array(lang))").alias("packages"),
        "source", F.expr("nullif(n_chars % 11, 10)").alias("result_count"), F.expr("date_add(date'2024-01-01', cast(doc_id % 7 as int))").alias("collected_on"),
    )


LOG = """log as (select doc_id as row_id, text as query, case when lang = 'en' then cast([] as varchar[]) else [lang] end as packages, source,
    nullif(n_chars % 11, 10) as result_count, date '2024-01-01' + cast(doc_id % 7 as integer) as collected_on from documents)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, source, text, packages, result_count, day of events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("position"), F.col("event_type").alias("source"), F.concat("event_type", F.lit(" "), "props").alias("text"),
        F.expr("if(user_id % 3 = 0, array(concat('pkg', user_id % 5)), cast(array() as array<string>))").alias("packages"),
        F.expr("nullif(cast(floor(abs(value)) as bigint) % 60, 7)").alias("result_count"), F.to_date("ts").alias("day"),
    )


REQUESTS = """requests as (select event_id as position, event_type as source, event_type || ' ' || props as text,
    case when user_id % 3 = 0 then ['pkg' || (user_id % 5)] else cast([] as varchar[]) end as packages,
    nullif(cast(floor(abs(value)) as bigint) % 60, 7) as result_count, cast(ts as date) as day from events)"""


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text of every turn."""
    return table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), "text")


CHAT = "chat as (select conv_id * 1000 + turn as id, text from conversations)"


def run(spark: SparkSession, sf_dir: str, by: str = "l_extendedprice") -> DataFrame:
    """q, doc, rank: the parts of an order, ranked by a column; parts may repeat."""
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(F.desc(by), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    return line.where("l_orderkey % 13 <> 0").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("doc"), F.row_number().over(order).cast("long").alias("rank"))


def run_sql(name: str = "run", by: str = "l_extendedprice") -> str:
    return f"""{name} as (select l_orderkey as q, l_partkey as doc, row_number() over (partition by l_orderkey order by {by} desc, l_partkey, l_suppkey,
    l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as rank from lineitem where l_orderkey % 13 <> 0)"""


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, doc, grade 0 to 3; a fifth of the parts is not judged."""
    line = table(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0")
    return line.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("doc")).agg(F.max((F.col("l_partkey") + F.col("l_suppkey")) % 4).alias("grade"))


QRELS = "qrels as (select l_orderkey as q, l_partkey as doc, max((l_partkey + l_suppkey) % 4) as grade from lineitem where l_partkey % 5 <> 0 group by all)"


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, group_id, track, answerability, status, abstained, latency_ms, cost_usd: a query and the outcome of its request (null status: missing)."""
    o = table(spark, sf_dir, "orders")
    judged = qrels(spark, sf_dir).groupBy("q").agg(F.max("grade").alias("best"))
    return o.join(judged, o.o_orderkey == judged.q, "left").select(
        F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("track"),
        F.expr("case when best >= 2 then 'answerable' when o_orderkey % 2 = 0 then 'unanswerable' else 'unknown' end").alias("answerability"),
        F.expr("case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 'error' else 'ok' end").alias("status"),
        F.expr("o_orderkey % 13 <> 0 and o_orderkey % 17 <> 0 and o_orderkey % 7 = 0").alias("abstained"),
        F.expr("if(o_orderkey % 13 = 0 or o_orderkey % 17 = 0, null, o_totalprice / 1000)").alias("latency_ms"),
        F.expr("if(o_orderkey % 13 = 0 or o_orderkey % 4 = 0, null, cast(o_custkey % 100 as double) / 64)").alias("cost_usd"),
    )


COLLECTION = """judged as (select q, max(grade) as best from qrels group by q),
collection as (select o_orderkey as q, o_custkey as group_id, o_orderpriority as track,
    case when best >= 2 then 'answerable' when o_orderkey % 2 = 0 then 'unanswerable' else 'unknown' end as answerability,
    case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 'error' else 'ok' end as status,
    o_orderkey % 13 <> 0 and o_orderkey % 17 <> 0 and o_orderkey % 7 = 0 as abstained,
    case when o_orderkey % 13 = 0 or o_orderkey % 17 = 0 then null else o_totalprice / 1000 end as latency_ms,
    case when o_orderkey % 13 = 0 or o_orderkey % 4 = 0 then null else cast(o_custkey % 100 as double) / 64 end as cost_usd
    from orders left join judged on q = o_orderkey)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, package, source_text: parts as declarations."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.col("p_brand").alias("package"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("source_text"), F.col("p_size").alias("size"))


CORPUS = "corpus as (select p_partkey as id, lower(p_name) as name, p_brand as package, lower(p_name || ' ' || p_type) as source_text, p_size as size from part)"
