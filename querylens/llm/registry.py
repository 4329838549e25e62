"""The queries of these operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, exact_dedup, langid, packing, pii, pipeline, secrets, simhash, toxicity, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, width=1, slice_bits=64, slice_radius=2, radius=2)
    return found.selectExpr("doc_id", "lpad(lower(hex(f0)), 16, '0') as fingerprint", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), remembered=packing.REMEMBERED_ALONE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_toxicity, op4_langid, op5_bpe, op6_secrets, op7_embeddings, op8_warc, op9_pii, op10_packing)} | {"pipeline": pipeline.run}

SQL: dict[str, str] = {
    "op1_exact_dedup": """
        with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from d""",
    "op7_embeddings": """
        with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
        ok as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        n as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from ok),
        link as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
                 where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        reach as (select vec_id as a, vec_id as b from v union select reach.a, link.b from reach join link on reach.b = link.a)
        select v.vec_id, (select count(*) from link where link.a = v.vec_id) as n_links, min(reach.b) as component_id, v.vec_id = min(reach.b) as kept
        from v join reach on reach.a = v.vec_id group by v.vec_id""",
    "op8_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, html, sha1(html) as hex, max(page_id) over (partition by html) as head from p)
        select page_id, octet_length(encode(html))::bigint as payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::bigint >> (5 * (3 - i % 4))::int) & 31)::int, 1)), 'string_agg', '') as payload_digest,
               case when page_id = head then 'response' else 'revisit' end as record_type,
               case when page_id <> head then head end as refers_to
        from d""",
}
