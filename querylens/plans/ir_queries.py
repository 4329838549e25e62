"""Queries that score ranked runs, compare them, and retrieve candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import inference, ranking, retrieval
from ..shared import small
from . import views

_KS = "ks as (select unnest([1, 5, 10]) as k)"
_BASE = f"{views.QRELS}, {views.COLLECTION}, {_KS}"


def _metrics_sql(run: str = "run", prefix: str = "") -> str:
    p = prefix
    return f"""{p}first as (select q, doc, min(rank) as rank from {run} group by all), {p}rel as (select q, count(*) as nrel from qrels where grade >= 2 group by all),
    {p}ideal as (select q, k, sum(grade / log2(r + 1)) as idcg from (select *, row_number() over (partition by q order by grade desc) as r from qrels) t, ks where r <= k group by all),
    {p}j as (select f.q, f.doc, f.rank, k, coalesce(grade, 0) as grade, case when grade is null then 0 else 1 end as judged, case when grade >= 2 then 1 else 0 end as hit from {p}first f left join qrels using (q, doc), ks where f.rank <= k),
    {p}h as (select *, sum(hit) over (partition by q, k order by rank rows between unbounded preceding and current row) as hits from {p}j),
    {p}got as (select q, k, sum(grade / log2(rank + 1)) as dcg, sum(hit) as hit, min(case when hit = 1 then rank end) as first_, sum(case when hit = 1 then hits::double / rank else 0 end) as ap, sum(judged) as judged from {p}h group by all),
    {p}scores as (select rel.q, ks.k, coalesce(dcg / idcg, 0) as ndcg, coalesce(hit::double / nrel, 0) as recall, case when hit > 0 then 1.0 else 0.0 end::double as success, coalesce(1.0 / first_, 0)::double as mrr,
        coalesce(ap / least(ks.k, nrel), 0) as map, coalesce(hit::double / ks.k, 0) as precision, coalesce(judged::double / ks.k, 0) as judged
        from {p}rel rel cross join ks left join {p}ideal i on i.q = rel.q and i.k = ks.k left join {p}got g on g.q = rel.q and g.k = ks.k)"""


_LONG = "select q, unnest([" + ", ".join(f"{{'metric': '{m}@' || k, 'value': {m}::double}}" for m in ranking.METRICS) + "], recursive := true) from scores where q in (select q from collection where answerability = 'answerable')"
_OUTCOMES = """ok as (select *, coalesce(status = 'ok', false) as fine, coalesce(abstained, false) and coalesce(status = 'ok', false) as quiet, q in (select q from run) as returned from collection),
    outcomes as (select q, 'request_success' as metric, fine::int::double as value from ok union all select q, 'false_abstention', quiet::int::double from ok where answerability = 'answerable'
    union all select q, 'correct_abstention', quiet::int::double from ok where answerability = 'unanswerable' union all select q, 'false_return', returned::int::double from ok where answerability = 'unanswerable')"""


def _rounded(df, digits=9):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"with {views.run_sql()}, {_BASE}, {_metrics_sql()} select q, k, " + ", ".join(f"round({m}, 9) as {m}" for m in ranking.METRICS) + " from scores")
def ir_query_metrics(spark, sf_dir):
    return _rounded(ranking.ranking_metrics(views.run(spark, sf_dir), views.qrels(spark, sf_dir)))


@query(f"with {views.run_sql()}, {_BASE}, {_OUTCOMES} select * from outcomes")
def ir_request_outcomes(spark, sf_dir):
    return ranking.outcomes(views.collection(spark, sf_dir), views.run(spark, sf_dir))


@query(f"with {views.run_sql()}, {_BASE}, {_metrics_sql()}, {_OUTCOMES}, every as ({_LONG} union all select * from outcomes), t as (select * from every join collection using (q)) select track, metric, round(avg(value), 9) as mean, count(*) as n from (select track, metric, value from t union all select 'all', metric, value from t) group by all")
def ir_track_summary(spark, sf_dir):
    c = views.collection(spark, sf_dir)
    return _rounded(ranking.track_summary(c, ranking.query_scores(c, views.run(spark, sf_dir), views.qrels(spark, sf_dir))))


@query(f"with {_BASE}, t as (select * from collection union all select * replace ('all' as track) from collection) select track, count(*) as scheduled, count(distinct group_id) as independent_groups, count(latency_ms) as latency_n, round(quantile_cont(latency_ms, 0.5), 9) as p50, round(quantile_cont(latency_ms, 0.95), 9) as p95, round(quantile_cont(latency_ms, 0.99), 9) as p99, count(cost_usd) as cost_n, round(sum(cost_usd), 9) as cost_total from t group by track")
def ir_latency_cost(spark, sf_dir):
    return _rounded(ranking.track_costs(views.collection(spark, sf_dir)))


def _routes(spark, sf_dir):
    """Routes by return flag, groups by line status, any part of a group will do."""
    return views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_returnflag").alias("route"), F.col("l_linenumber").alias("grp"), F.col("l_partkey").alias("doc")).distinct()


@query(f"""with {views.run_sql()}, {_KS}, routes as (select distinct l_orderkey as q, l_returnflag as route, l_linenumber as grp, l_partkey as doc from lineitem),
    g as (select routes.q, route, grp, k, max(case when rank <= k then 1.0 else 0.0 end) as hit from routes left join run on run.q = routes.q and run.doc = routes.doc cross join ks group by all),
    r as (select q, route, k, avg(hit) as share from g group by all) select q, k, round(max(share), 9) as best_route_group_recall, max(case when share = 1 then 1.0 else 0.0 end)::double as route_covered from r group by all""")
def ir_premise_routes(spark, sf_dir):
    return _rounded(ranking.premise_metrics(views.run(spark, sf_dir), _routes(spark, sf_dir)))


_ROUTES = """routes as (select distinct l_orderkey as q, l_returnflag as route, l_linenumber as grp, l_partkey as doc from lineitem),
    pg as (select routes.q, route, grp, k, max(case when rank <= k then 1.0 else 0.0 end) as hit from routes left join run on run.q = routes.q and run.doc = routes.doc cross join ks group by all),
    pr as (select q, route, k, avg(hit) as share from pg group by all), premise as (select q, k, max(share) as best_route_group_recall, max(case when share = 1 then 1.0 else 0.0 end)::double as route_covered from pr where q in (select q from collection where answerability = 'answerable') group by all)"""


@query(f"""with {views.run_sql()}, {_BASE}, {_metrics_sql()}, {_OUTCOMES}, {_ROUTES}, every as ({_LONG} union all select * from outcomes
    union all select q, unnest([{{'metric': 'best_route_group_recall@' || k, 'value': best_route_group_recall::double}}, {{'metric': 'route_covered@' || k, 'value': route_covered::double}}], recursive := true) from premise)
    select q, metric, round(value, 9) as value from every where metric not like '%@10'""")
def ir_all_scores(spark, sf_dir):
    """Every score of every query: relevance, routes, outcomes. The run declares a depth of 5, so the cutoff of 10 is unavailable."""
    c = views.collection(spark, sf_dir)
    return _rounded(ranking.query_scores(c, views.run(spark, sf_dir), views.qrels(spark, sf_dir), max_k=5, routes=_routes(spark, sf_dir)))


@query("select unnest([10, 20, 50, 100]) as cutoff")
def unavailable_cutoffs(spark, sf_dir):
    """Of the usual cutoffs those that a run of depth 5 cannot be scored at."""
    return spark.createDataFrame([(k,) for k in ranking.unavailable((1, 5, 10, 20, 50, 100), 5)], "cutoff int")


def _other_side(spark, sf_dir):
    """A second evaluation that differs: queries left out, other tracks, other grades, judgments more and less."""
    c, q = views.collection(spark, sf_dir), views.qrels(spark, sf_dir)
    return c.where("q % 29 <> 0").withColumn("track", F.expr("if(q % 31 = 0, 'human', track)")), q.where("doc % 41 <> 0").withColumn("grade", F.expr("if(doc % 37 = 0, (grade + 1) % 4, grade)"))


@query(f"""with {views.QRELS}, {views.COLLECTION}, o as (select * replace (case when q % 31 = 0 then 'human' else track end as track) from collection where q % 29 <> 0),
    j as (select q, doc, case when doc % 37 = 0 then (grade + 1) % 4 else grade end as grade from qrels where doc % 41 <> 0)
    select 'query scheduled on one side only' as rule, count(*) as violations from collection a full join o b on a.q = b.q where a.q is null or b.q is null
    union all select 'query metadata differ', count(*) from collection a join o b on a.q = b.q where a.track is distinct from b.track or a.group_id is distinct from b.group_id or a.answerability is distinct from b.answerability
    union all select 'judgments differ', count(*) from qrels a full join j b on a.q = b.q and a.doc = b.doc where a.grade is distinct from b.grade""")
def compare_guards(spark, sf_dir):
    """What keeps two evaluations from being compared."""
    return inference.differences(views.collection(spark, sf_dir), (other := _other_side(spark, sf_dir))[0], views.qrels(spark, sf_dir), other[1])


def _two_stages(spark, sf_dir):
    return views.run(spark, sf_dir).select("q", F.lit("price").alias("stage"), F.col("doc").alias("id"), "rank").unionByName(views.run(spark, sf_dir, "l_quantity").select("q", F.lit("quantity").alias("stage"), F.col("doc").alias("id"), "rank"))


_STAGED = f"{views.run_sql('price', 'l_extendedprice')}, {views.run_sql('quantity', 'l_quantity')}, {views.QRELS}, rel as (select q, doc from qrels where grade >= 2), trace as (select q, 'price' as stage, doc, rank from price union all select q, 'quantity', doc, rank from quantity)"


@query(f"with {_STAGED} select q, stage, doc as id, min(rank) as rank from trace join rel using (q, doc) group by all")
def stage_relevant_ranks(spark, sf_dir):
    """The first place of each relevant document in each stage."""
    return ranking.relevant_ranks(_two_stages(spark, sf_dir), views.qrels(spark, sf_dir).where("grade >= 2").select("q", "doc"))


@query(f"""with {_STAGED}, n as (select q, count(*) as nrel from rel group by all), d as (select q, stage, max(rank) as k from trace group by all),
    f as (select q, stage, count(*) as n, min(rank) as first_rank, sum(1 / log2(rank + 1)) as dcg from trace join rel using (q, doc) group by all),
    i as (select d.q, d.stage, sum(1 / log2(r + 1)) as idcg from d join n using (q), range(1, 100) t(r) where r <= nrel and r <= k group by all)
    select q, stage, k, case when f.n > 0 then 1.0 else 0.0 end::double as hit, round(coalesce(f.n::double / nrel, 0), 9) as recall, round(coalesce(1.0 / first_rank, 0), 9) as mrr, round(coalesce(dcg / idcg, 0), 9) as ndcg, first_rank
    from d join n using (q) left join f using (q, stage) join i using (q, stage)""")
def stage_metrics(spark, sf_dir):
    """Binary metrics of each stage at the depth of its own list."""
    return _rounded(ranking.stage_metrics(_two_stages(spark, sf_dir), views.qrels(spark, sf_dir).where("grade >= 2").select("q", "doc")))


@query(f"""with {views.run_sql()}, {_BASE}, c as (select c.*, best from collection c left join judged using (q))
    select 'null id' as rule, count(*) filter (where q is null) as violations from c union all select 'null group', count(*) filter (where group_id is null) from c union all select 'null track', count(*) filter (where track is null) from c
    union all select 'unknown answerability', count(*) filter (where answerability not in ('answerable', 'unanswerable', 'unknown')) from c
    union all select 'answerable without a relevant document', count(*) filter (where answerability = 'answerable' and coalesce(best, 0) < 2) from c
    union all select 'unanswerable with a relevant document', count(*) filter (where answerability = 'unanswerable' and best >= 2) from c
    union all select 'unknown status', count(*) filter (where status not in ('ok', 'error', 'timeout')) from c
    union all select 'abstained without success', count(*) filter (where abstained and coalesce(status, 'missing') <> 'ok') from c
    union all select 'negative or infinite latency', count(*) filter (where latency_ms < 0 or not isfinite(latency_ms)) from c
    union all select 'negative or infinite cost', count(*) filter (where cost_usd < 0 or not isfinite(cost_usd)) from c
    union all select 'duplicate id', count(*) from (select q from collection group by q having count(*) > 1)
    union all select 'run of an unknown query', count(*) from (select distinct q from run where q not in (select q from collection))
    union all select 'grade out of range', count(*) filter (where grade not between 0 and 3) from qrels
    union all select 'rank below 1', count(*) filter (where rank < 1) from run""")
def ir_validate(spark, sf_dir):
    return ranking.violations(views.collection(spark, sf_dir), views.run(spark, sf_dir), views.qrels(spark, sf_dir))


@query(f"""with {views.run_sql()}, {views.QRELS}, rel as (select q, doc from qrels where grade = 3), n as (select q, count(*) as nrel from rel group by all),
    f as (select run.q, count(*) as n, min(rank) as first_, sum(1 / log2(rank + 1)) as dcg from run join rel using (q, doc) where rank <= 5 group by all),
    i as (select q, sum(1 / log2(r + 1)) as idcg from n, range(1, 6) t(r) where r <= nrel group by all)
    select q, case when n > 0 then 1.0 else 0.0 end::double as hit, round(coalesce(f.n::double / nrel, 0), 9) as recall, round(coalesce(1.0 / first_, 0), 9) as mrr, round(coalesce(dcg / idcg, 0), 9) as ndcg from n left join f using (q) join i using (q)""")
def pilot_binary_metrics(spark, sf_dir):
    relevant = views.qrels(spark, sf_dir).where("grade = 3").select("q", "doc")
    return _rounded(ranking.binary_metrics(views.run(spark, sf_dir), relevant, 5))


def _records(spark, sf_dir):
    relevant = views.qrels(spark, sf_dir).where("grade >= 2").select("q", "doc")
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("price"))
    out = None
    for variant, by in (("price", "l_extendedprice"), ("quantity", "l_quantity")):
        run = views.run(spark, sf_dir, by)
        deep = ranking.binary_metrics(run, relevant, 10).select("q", F.col("recall").alias("candidate_recall")).where("q % 6 <> 0")
        m = ranking.binary_metrics(run, relevant, 3).join(deep, "q", "left").join(orders, "q").withColumn("variant", F.lit(variant)).withColumn("latency_ms", F.col("price") / (1 if variant == "price" else 2))
        out = m if out is None else out.unionByName(m)
    return out


def _variants_sql() -> str:
    one = """{v}f as (select r.q, count(*) filter (where rank <= 3) as n, count(*) filter (where rank <= 10) as deep, min(case when rank <= 3 then rank end) as first_, sum(case when rank <= 3 then 1 / log2(rank + 1) else 0 end) as dcg from {v} r join rel using (q, doc) group by all),
    {v}r as (select n.q, '{v}' as variant, o_orderpriority as category, o_totalprice / {d} as latency_ms, case when f.n > 0 then 1.0 else 0.0 end as hit, coalesce(f.n::double / nrel, 0) as recall, coalesce(1.0 / first_, 0) as mrr, coalesce(dcg / idcg, 0) as ndcg,
        case when n.q % 6 <> 0 then coalesce(deep::double / nrel, 0) else 0 end as candidate_recall from n left join {v}f f using (q) join i using (q) join orders on o_orderkey = n.q)""".format
    return f"""with {views.run_sql('price', 'l_extendedprice')}, {views.run_sql('quantity', 'l_quantity')}, {views.QRELS}, rel as (select q, doc from qrels where grade >= 2), n as (select q, count(*) as nrel from rel group by all),
    i as (select q, sum(1 / log2(r + 1)) as idcg from n, range(1, 4) t(r) where r <= nrel group by all), {one(v='price', d=1)}, {one(v='quantity', d=2)}, every as (select * from pricer union all select * from quantityr),
    both_ as (select * from every union all select * replace ('__all__' as category) from every)
    select variant, category, count(distinct q) as queries, count(*) as runs, round(avg(hit), 9) as hit, round(avg(recall), 9) as recall, round(avg(mrr), 9) as mrr, round(avg(ndcg), 9) as ndcg, round(avg(candidate_recall), 9) as candidate_recall,
        round(median(latency_ms), 9) as latency_p50_ms, round(quantile_disc(latency_ms, 0.95), 9) as latency_p95_ms from both_ group by all"""


@query(_variants_sql())
def variant_grid_summary(spark, sf_dir):
    return _rounded(ranking.variant_summary(_records(spark, sf_dir)))


def _pair(spark, sf_dir):
    c = views.collection(spark, sf_dir)
    q = views.qrels(spark, sf_dir)
    a, b = (ranking.query_scores(c, views.run(spark, sf_dir, by), q, (5,)) for by in ("l_extendedprice", "l_quantity"))
    return inference.paired(c, a, b, "ndcg@5")


_PAIRED = f"""with {views.run_sql()}, {views.run_sql('other', 'l_quantity')}, {views.QRELS}, {views.COLLECTION}, ks as (select 5 as k), {_metrics_sql()}, {_metrics_sql('other', 'b_')},
    g as (select group_id, sum(b.ndcg - a.ndcg) as s, count(*) as n from scores a join b_scores b using (q) join collection c using (q) where answerability = 'answerable' group by all)"""


@query(_PAIRED + " select sum(n)::bigint as n_queries, count(*) as n_groups, round(sum(s) / sum(n), 9) as candidate_minus_baseline from g")
def compare_paired_effect(spark, sf_dir):
    return _rounded(inference.effect(_pair(spark, sf_dir)))


#: Resamples, as many as the reference takes.
SAMPLES = 10_000


@query(_PAIRED.replace("where answerability = 'answerable'", "where answerability = 'answerable' and track = '1-URGENT'") + " select sum(n)::bigint as n_queries, count(*) as n_groups, round(sum(s) / sum(n), 9) as candidate_minus_baseline from g")
def compare_track_effect(spark, sf_dir):
    c, q = views.collection(spark, sf_dir), views.qrels(spark, sf_dir)
    a, b = (ranking.query_scores(c, views.run(spark, sf_dir, by), q, (5,)) for by in ("l_extendedprice", "l_quantity"))
    return _rounded(inference.effect(inference.paired(c, a, b, "ndcg@5", "1-URGENT")))


@query()
def bootstrap_ci(spark, sf_dir):
    return inference.bootstrap_interval(_pair(spark, sf_dir), samples=SAMPLES)


@query()
def sign_randomization(spark, sf_dir):
    return inference.sign_randomization(_pair(spark, sf_dir), samples=SAMPLES)


@query("""with p as (select p_partkey as id, p_brand as family, (p_partkey * 37 % 1009) / 2018.0::double as p from part), r as (select *, row_number() over (partition by family order by p, id) as r, count(*) over (partition by family) as m from p)
    select id, family, round(p, 9) as p, round(max(least(1.0::double, (m - r + 1) * p)) over (partition by family order by p, id rows between unbounded preceding and current row), 9) as adjusted from r""")
def holm_adjust(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), F.expr("cast(p_partkey * 37 % 1009 as double) / 2018.0D").alias("p"))
    return _rounded(inference.holm(p, ["family"]))


def _searches(spark, sf_dir):
    """A stated set of queries: the names of 25 suppliers' nations' parts."""
    n = views.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("q"), F.expr("array('red widget', 'small ring', 'blue bolt', 'green', 'large plate economy')[n_nationkey % 5]").alias("text"), F.expr("if(n_nationkey % 2 = 0, array(concat('Brand#', n_nationkey)), array())").alias("packages"))


_SEARCH = "searches as (select n_nationkey as q, (['red widget', 'small ring', 'blue bolt', 'green', 'large plate economy'])[1 + n_nationkey % 5] as text, case when n_nationkey % 2 = 0 then ['Brand#' || n_nationkey] else cast([] as varchar[]) end as packages from nation)"
_BM25 = f"""{views.CORPUS}, {_SEARCH}, tok as (select id, regexp_extract_all(source_text, '[a-z0-9]+') as w from corpus), st as (select count(*) as n, avg(len(w)) as av from tok),
    post as (select id, len(w) as len_, term, count(*) as tf from (select id, w, unnest(w) as term from tok) group by id, len(w), term), df as (select term, count(*) as df from post group by all),
    qt as (select distinct q, unnest(regexp_extract_all(text, '[a-z0-9]+')) as term from searches),
    bm as (select q, id, round(sum(ln((n + 1)::double / df) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len_ / av)) + 1)), 9) as score from qt join df using (term) join post using (term), st group by all),
    lexical as (select *, row_number() over (partition by q order by score desc, id) as rank from bm where score > 0 qualify rank <= 20)"""


def _docs(spark, sf_dir):
    return views.corpus(spark, sf_dir).withColumnRenamed("source_text", "text")


@query(f"with {_BM25} select q, id, round(score, 6) as score, rank from lexical")
def bm25_topk(spark, sf_dir):
    return _rounded(retrieval.bm25(_searches(spark, sf_dir), _docs(spark, sf_dir), 20), 6).withColumn("rank", F.col("rank").cast("long"))


@query("""with e as (select vec_id as id, embedding as v from embeddings), qs as (select id as q, v as qv from e where id % 50 = 0), s as (select q, id, round(list_sum(list_transform(list_zip(qv, v), lambda p: p[1]::double * p[2]::double)), 9) as score from qs, e),
    r as (select *, row_number() over (partition by q order by score desc, id) as rank from s) select q, id, round(score, 6) as score, rank from r where rank <= 10""")
def vector_topk(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _rounded(retrieval.vector_top(e.where("id % 50 = 0").select(F.col("id").alias("q"), "v"), e, 10), 6).withColumn("rank", F.col("rank").cast("long"))


_RRF = f"""{_BM25}, byname as (select q, id, row_number() over (partition by q order by length(name), id) as rank from searches, corpus where contains(source_text, regexp_extract(text, '[a-z]+')) qualify rank <= 20),
    fused as (select q, id, round(sum(1.0::double / (60 + rank)), 12) as score from (select q, id, rank from lexical union all select q, id, rank from byname) group by all), ranked as (select *, row_number() over (partition by q order by score desc, id) as rank from fused)"""


def _fused(spark, sf_dir):
    from pyspark.sql import Window

    q, d = _searches(spark, sf_dir), _docs(spark, sf_dir)
    byname = d.join(small(q.select("q", F.regexp_extract("text", "[a-z]+", 0).alias("w"))), F.expr("contains(text, w)")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.length("name"), "id"))).where("rank <= 20").select("q", "id", "rank")
    return retrieval.fuse(retrieval.bm25(q, d, 20), byname)


@query(f"with {_RRF} select q, id, round(score, 9) as score, rank from ranked where rank <= 500")
def rrf_fusion(spark, sf_dir):
    return _rounded(_fused(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {_RRF}, f as (select r.q, r.id, row_number() over (partition by r.q order by rank) as rank from ranked r join corpus using (id) join searches using (q) where len(packages) = 0 or list_contains(packages, package)) select q, id, rank from f where rank <= 10")
def pool_cut_filter(spark, sf_dir):
    q = _searches(spark, sf_dir)
    return retrieval.cut(retrieval.package_filter(_fused(spark, sf_dir), _docs(spark, sf_dir), q.select("q", "packages")), 10).select("q", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_RRF}, s as (select r.q, r.id, r.rank as before, len(list_intersect(list_distinct(regexp_extract_all(text, '[a-z0-9]+')), list_distinct(regexp_extract_all(source_text, '[a-z0-9]+'))))::double / greatest(len(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))), 1) as score
    from ranked r join corpus using (id) join searches using (q) where rank <= 10) select q, id, round(score, 9) as score, row_number() over (partition by q order by score desc, before) as rank from s""")
def word_overlap_rerank(spark, sf_dir):
    ranked = retrieval.rerank(retrieval.cut(_fused(spark, sf_dir), 10), _searches(spark, sf_dir), _docs(spark, sf_dir))
    return _rounded(ranked).withColumn("rank", F.col("rank").cast("long"))


@query()
def hashed_word_vectors(spark, sf_dir):
    return retrieval.hashed_words(_docs(spark, sf_dir), "text").select("id", "v")


@query(f"with {views.CORPUS}, {_SEARCH} select q, w.word as name, min(id) as id, count(id) as found, count(id) = 0 as missing from (select q, unnest(['small ring', 'red widget', 'no such part']) as word from searches) w left join corpus on name = word group by all")
def target_resolution(spark, sf_dir):
    wanted = _searches(spark, sf_dir).select("q", F.explode(F.array(*(F.lit(x) for x in ("small ring", "red widget", "no such part")))).alias("name"))
    return retrieval.resolve_targets(wanted, views.corpus(spark, sf_dir))


@query(f"with {views.CORPUS}, {_SEARCH}, w as (select q, packages, unnest(['small ring', 'red widget', 'no such part']) as name from searches), m as (select q, w.name, case when len(packages) = 0 or list_contains(packages, package) then id end as id from w left join corpus using (name)) select q, name, min(id) as id, count(id) as found, count(id) = 0 as missing from m group by all")
def target_resolution_filtered(spark, sf_dir):
    """Targets by name within the packages that their query lists; one outside of them is missing."""
    q = _searches(spark, sf_dir)
    wanted = q.select("q", F.explode(F.array(*(F.lit(x) for x in ("small ring", "red widget", "no such part")))).alias("name"))
    return retrieval.resolve_targets(wanted, views.corpus(spark, sf_dir), q.select("q", "packages"))


_TWO = "greatest(coalesce(r.score, 0), coalesce(s.score, 0))"


def _index_sql(prefix: str, tokens) -> str:
    p = prefix
    return f"""{p}tok as (select id, {tokens('name')} as w from corpus), {p}st as (select count(*) as n, avg(len(w)) as av from {p}tok),
    {p}post as (select id, len(w) as len_, term, count(*) as tf from (select id, w, unnest(w) as term from {p}tok) group by id, len(w), term), {p}df as (select term, count(*) as df from {p}post group by all),
    {p}qt as (select distinct q, unnest({tokens('text')}) as term from searches),
    {p} as (select q, id, round(sum(ln((n + 1)::double / df) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len_ / av)) + 1)), 9) as score from {p}qt join {p}df using (term) join {p}post using (term), {p}st group by all)"""


@query(f"""with {views.CORPUS}, {_SEARCH}, {_index_sql('raw', lambda x: f"regexp_extract_all(lower({x}), '[^ ]+')")}, {_index_sql('split', lambda x: f"regexp_extract_all(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '{chr(92)}1 {chr(92)}2', 'g')), '[a-z0-9]+')")},
    best as (select q, id, max(score) as score from (select * from raw union all select * from split) where score > 0 group by all)
    select q, id, round(score, 6) as score, row_number() over (partition by q order by best.score desc, id) as rank from best qualify rank <= 20""")
def bm25_two_indices(spark, sf_dir):
    """Names by two indices, whole tokens and their parts."""
    return _rounded(retrieval.bm25_names(_searches(spark, sf_dir), _docs(spark, sf_dir), 20), 6).withColumn("rank", F.col("rank").cast("long"))


def _edges(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.expr("(id * 7) % 100").alias("needs"))


@query(f"""with {_RRF}, pool as (select * from ranked where rank <= 500), gain as (select q, (id * 7) % 100 as id, max(score) as by_ from pool group by all), b as (select p.q, p.id, p.score + 0.1 * coalesce(by_, 0) as score from pool p left join gain g on g.q = p.q and g.id = p.id)
    select q, id, round(score, 9) as score, row_number() over (partition by q order by b.score desc, id) as rank from b""")
def selection_boost(spark, sf_dir):
    """The pool after candidates on which others depend have risen."""
    return _rounded(retrieval.boost(_fused(spark, sf_dir), _edges(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


_MIXED = f"""{_RRF}, m as (select r.q, r.id, r.rank as before, round(len(list_intersect(list_distinct(regexp_extract_all(text, '[a-z0-9]+')), list_distinct(regexp_extract_all(source_text, '[a-z0-9]+'))))::double / greatest(len(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))), 1) + 0.5 * r.score, 12) as score
    from ranked r join corpus using (id) join searches using (q) where rank <= 10), mixed as (select q, id, score, row_number() over (partition by q order by score desc, before) as rank from m)"""


def _mixed(spark, sf_dir):
    return retrieval.rerank(retrieval.cut(_fused(spark, sf_dir), 10), _searches(spark, sf_dir), _docs(spark, sf_dir), mix=0.5)


@query(f"with {_MIXED} select q, id, round(score, 9) as score, rank from mixed")
def reranked_mixture(spark, sf_dir):
    return _rounded(_mixed(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {_MIXED}, v as (select q, mixed.id, row_number() over (partition by q order by rank) as rank from mixed join corpus using (id) where not regexp_matches(name, '^(small|green)')) select q, id, rank from v where rank <= 5")
def results_stage(spark, sf_dir):
    """What a search returns: candidates whose names are not made by a program (here: of two colours), then the limit."""
    return retrieval.cut(retrieval.visible(_mixed(spark, sf_dir), _docs(spark, sf_dir), "^(small|green)"), 5).select("q", "id", F.col("rank").cast("long").alias("rank"))


@query()
def retrieval_stages(spark, sf_dir):
    """The whole trace of a search, all stages; models' places are taken by deterministic stand-ins."""
    return retrieval.stages(_searches(spark, sf_dir), _docs(spark, sf_dir), depth=50, limit=10, edges=_edges(spark, sf_dir))


@query()
def variant_experiment(spark, sf_dir):
    """Every stage under two variants, scored against a stated set of targets; times are of this run."""
    q = _searches(spark, sf_dir)
    relevant = views.corpus(spark, sf_dir).where("id % 7 = 0").select(F.col("id").alias("doc"), F.expr("id % 25").alias("q"))
    variants = [{"depth": 50, "exclude_zero": True, "boost": True}, {"depth": 0, "exclude_zero": False, "boost": False}]
    return retrieval.run_experiment(q, _docs(spark, sf_dir), relevant, variants, edges=_edges(spark, sf_dir))


@query("select q, d as depth, z as exclude_zero, b as boost from (select n_nationkey as q from nation), (select unnest([0, 50, 100]) as d), (select unnest([true, false]) as z), (select unnest([true, false]) as b)")
def variant_grid(spark, sf_dir):
    """Each query under each variant."""
    return retrieval.variant_grid(_searches(spark, sf_dir))


@query(f"with {_BM25}, every as (select q, id, coalesce(score, 0) as score from searches cross join corpus left join bm using (q, id)), r as (select *, row_number() over (partition by q order by score desc, id) as rank from every qualify rank <= 200) select q, count(*) as candidates, count(*) filter (where score > 0) as positive, count(*) filter (where score = 0) as zero, min(rank) filter (where id % 7 = 0) as target_rank from r group by q")
def lexical_audit(spark, sf_dir):
    """For each query: candidates, how many score above zero and how many do not, and the rank of the first target."""
    d = _docs(spark, sf_dir)
    return retrieval.lexical_audit(_searches(spark, sf_dir), d, d.where("id % 7 = 0"))
