"""Queries over clusters and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..functions.dialect import DUCK
from ..operators import clusters, report
from ..shared import materialize
from . import views

_LANGS = ("de", "en", "es", "fr")


def _points(spark, sf_dir):
    """User turns as points: a cluster from the conversation, one of five being noise."""
    kinds = views.chat(spark, sf_dir).withColumn("kinds", F.expr(text.kinds("text")))
    m = text.measures("text", "kinds")
    return kinds.select("id", "text", F.expr("cast((id div 1000) % 5 - 1 as int)").alias("cluster"), F.expr(text.once(text.words("text"), text.length_class)).alias("category"), F.expr("if(id % 3 = 0, array('api', 'web'), array('web'))").alias("sources"), F.expr(text.skeleton("kinds")).alias("skeleton"), *(F.expr(e).alias(n) for n, e in m.items()))


_POINTS = f"""{views.CHAT}, kk as (select *, {text.kinds('text', DUCK)} as kinds from chat), points as (select id, text, cast((id // 1000) % 5 - 1 as integer) as cluster, {text.length_class(text.words('text', DUCK))} as category,
    case when id % 3 = 0 then ['api', 'web'] else ['web'] end as sources, {text.skeleton('kinds', DUCK)} as skeleton, {', '.join(f'{e} as {n}' for n, e in text.measures('text', 'kinds', DUCK).items())} from kk)"""


def _rounded(df, digits=9):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"""with {views.CHAT}, t as (select cast((id // 1000) % 5 - 1 as integer) as cluster, unnest(regexp_extract_all(text, {DUCK.text(clusters.TERM)})) as term from chat), n as (select cluster, term, count(*) as n from t where cluster >= 0 group by all),
    p as (select cluster, sum(n) as size from n group by all), a as (select term, sum(n) as total from n group by all), v as (select avg(size) as av from p),
    s as (select cluster, term, round(n::double / size * ln(1 + av / total), 12) as score from n join p using (cluster) join a using (term), v), r as (select *, row_number() over (partition by cluster order by score desc, term) as rank from s)
    select cluster, rank, term, round(score, 9) as score from r where rank <= 8""")
def ctfidf_keywords(spark, sf_dir):
    return _rounded(clusters.keywords(_points(spark, sf_dir)))


@query(f"""with {_POINTS}, e as (select cluster, unnest(sources) as source from points), m as (select cluster, source, count(*)::double / sum(count(*)) over (partition by cluster) as share from e group by cluster, source),
    mix as (select cluster, string_agg(source || ' ' || cast(round(share * 100, 0) as integer) || '%', ', ' order by -share, source) as sources from m group by cluster),
    c as (select cluster, category, count(*) as n from points group by all), mode_ as (select cluster, arg_min(category, (-n, category)) as main_category from c group by all)
    select p.cluster, count(*) as queries, any_value(main_category) as main_category, median(n_words)::double as median_words, round(avg(identifier_share), 2) as identifier_share, any_value(mix.sources) as sources, row_number() over (order by p.cluster < 0, count(*) desc, p.cluster) as place from points p join mix using (cluster) join mode_ using (cluster) group by p.cluster""")
def cluster_summary(spark, sf_dir):
    """Clusters from the largest to the smallest, noise last."""
    return clusters.ordered_summary(clusters.cluster_summary(_points(spark, sf_dir))).withColumn("median_words", F.col("median_words").cast("double"))


@query("select source, " + ", ".join(f"round(coalesce(sum(case when lang = '{x}' then 1 else 0 end)::double / nullif(sum(case when lang in {_LANGS} then 1 else 0 end), 0), 0), 9) as {x}" for x in _LANGS) + " from documents group by source")
def share_pivot(spark, sf_dir):
    cells = views.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(clusters.share_pivot(cells, "source", "lang", "n", list(_LANGS)))


_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0".format


@query("with r as (select " + ", ".join(f"{_RANK(c)} as {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " from lineitem) " + " union all ".join(f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 6) as r from r" for x in ("l_quantity", "l_extendedprice", "l_discount") for y in ("l_quantity", "l_extendedprice", "l_discount")))
def spearman_matrix(spark, sf_dir):
    line = views.table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    return _rounded(clusters.correlations(line, line.columns), 6)


def _labelled(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(F.expr("p_size % 4").alias("a"), F.expr("(p_size + p_partkey % 2) % 4").alias("b"))


_LABELLED = "d as (select p_size % 4 as a, (p_size + p_partkey % 2) % 4 as b from part), c as (select a, b, count(*) as n from d group by all), l as (select a, sum(n) as na from c group by all), r as (select b, sum(n) as nb from c group by all)"


@query(f"with {_LABELLED}, s as (select (select sum(n * (n - 1) / 2.0) from c) as i, (select sum(na * (na - 1) / 2.0) from l) as l, (select sum(nb * (nb - 1) / 2.0) from r) as r, (select sum(n) from c) as n) select round((i - l * r / (n * (n - 1) / 2.0)) / ((l + r) / 2 - l * r / (n * (n - 1) / 2.0)), 9)::double as ari from s")
def rand_index(spark, sf_dir):
    return _rounded(clusters.rand_index(_labelled(spark, sf_dir), "a", "b"))


@query(f"with {_LABELLED} select a as label, round(max(n::double / (na + nb - n)), 9) as jaccard from c join l using (a) join r using (b) group by a")
def label_jaccard(spark, sf_dir):
    return _rounded(clusters.best_jaccard(_labelled(spark, sf_dir), "a", "b"))


@query(f"""with {_POINTS}, s as (select category, skeleton, count(*) as n from points group by all), f as (select category, string_agg(skeleton || ' (' || n || ')', ' · ' order by n desc, skeleton) as common from (select *, row_number() over (partition by category order by n desc, skeleton) as r from s where n >= 10) where r <= 3 group by all)
    select p.category, row_number() over (order by p.category) as place, round(100.0 * count(*) / (select count(*) from points), 2)::double as share_of_searches, median(n_words)::double as median_words, round(avg(identifier_share), 2) as identifier_share, round(avg(function_word_share), 2) as prose_share, round(avg(symbol_share), 2) as symbol_share, coalesce(any_value(common), '') as common_skeletons
    from points p left join f using (category) group by p.category having count(*) >= 10""")
def describe_categories(spark, sf_dir):
    return report.describe_categories(_points(spark, sf_dir))


@query()
def skeleton_tfidf(spark, sf_dir):
    return clusters.skeleton_weights(_points(spark, sf_dir).select("id", "skeleton"), "id")


@query()
def skeleton_components(spark, sf_dir):
    """The skeletons' leading components, a row for each turn and component."""
    rows, grams = clusters.skeleton_rows(_points(spark, sf_dir).select("id", "skeleton"), "id")
    return clusters.row_components(rows, len(grams), "id").select("id", F.posexplode("components").alias("component", "value"))


def _style(spark, sf_dir):
    return materialize(clusters.style_features(_points(spark, sf_dir), "id").select("id", "features"), "style")


@query()
def gmm_categories(spark, sf_dir):
    """Style categories over the standardised measures and components: two levels of the largest stable numbers of classes."""
    return clusters.fit_categories(_style(spark, sf_dir), "id")[0]


@query()
def category_selection(spark, sf_dir):
    """How stable each number of classes is: information criterion, agreement and worst overlap of refits."""
    return clusters.select_classes(_style(spark, sf_dir), "id", most=4, rounds=4)[1]


_PAIRS = ("l_quantity", "l_extendedprice", "l_discount")


@query(" union all ".join(f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 6) as r from lineitem" for x in _PAIRS for y in _PAIRS))
def pearson_matrix(spark, sf_dir):
    return _rounded(clusters.correlations(views.table(spark, sf_dir, "lineitem").select(*_PAIRS), list(_PAIRS), "pearson"), 6)


@query("""with c as (select p_size as x, p_size % 7 + p_partkey % 3 as y, count(*) as n from part group by all), t as (select sum(n) as n from c),
    s as (select sum(a.n * b.n * sign(b.y - a.y)) as s from c a join c b on a.x < b.x), tx as (select sum(n * (n - 1) / 2.0) as tx from (select sum(n) as n from c group by x)), ty as (select sum(n * (n - 1) / 2.0) as ty from (select sum(n) as n from c group by y))
    select round(s / sqrt((n * (n - 1) / 2.0 - tx) * (n * (n - 1) / 2.0 - ty)), 9)::double as tau from s, t, tx, ty""")
def kendall_tau(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select(F.col("p_size").alias("x"), F.expr("p_size % 7 + p_partkey % 3").alias("y"))
    return _rounded(clusters.kendall(part, "x", "y"))


@query("with s as (select p_size % 6 as label, count(*) as n from part group by all), r as (select label, cast(row_number() over (order by n desc, label) as varchar) as category from s) select p_partkey as id, category from part join r on p_size % 6 = label")
def renumbered_classes(spark, sf_dir):
    labels = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_size % 6").alias("label"))
    return clusters.renumbered(labels, "id")


@query()
def pca_2d(spark, sf_dir):
    return clusters.project(views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
