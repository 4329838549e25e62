"""Queries over the query log and the export: text, groups, gates, profiles, windows, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import numbers, text
from ..functions.dialect import DUCK
from ..operators import clusters, gate, groups, report, sampling, workload
from ..shared import materialize, spread
from . import views


def _norm_sql(x: str, operators: bool) -> str:
    return text.normalized(f"nfc_normalize({x})", DUCK, operators)


@query(f"with {views.LOG} select row_id, {_norm_sql('query', True)} as log_form, {_norm_sql('query', False)} as export_form from log")
def normalize_text(spark, sf_dir):
    rows = views.log(spark, sf_dir).withColumn("n", text.nfc(F.col("query")))
    return rows.select("row_id", F.expr(text.normalized("n")).alias("log_form"), F.expr(text.normalized("n", operators=False)).alias("export_form"))


@query(f"with {views.REQUESTS} select position, {_norm_sql('text', False)} as norm, array_to_string({DUCK.distinct_sorted('packages')}, ',') as filters from requests")
def request_key(spark, sf_dir):
    return workload.with_request_key(views.requests(spark, sf_dir)).select("position", "norm", F.array_join("filters", ",").alias("filters"))


@query(f"with {views.CHAT} select id, {text.skeleton(text.kinds('text', DUCK), DUCK)} as skeleton, len({text.tokens('text', DUCK)}) as n_tokens from chat")
def token_skeleton(spark, sf_dir):
    rows = views.chat(spark, sf_dir).withColumn("kinds", F.expr(text.kinds("text")))
    return rows.select("id", F.expr(text.skeleton("kinds")).alias("skeleton"), F.size("kinds").cast("long").alias("n_tokens"))


@query(f"with {views.CHAT}, k as (select *, {text.kinds('text', DUCK)} as kinds from chat) select id, " + ", ".join(f"round({e}, 9) as {n}" if n.endswith("share") else f"{e} as {n}" for n, e in text.measures("text", "kinds", DUCK).items()) + " from k")
def query_features(spark, sf_dir):
    rows = views.chat(spark, sf_dir).withColumn("kinds", F.expr(text.kinds("text")))
    return rows.select("id", *(F.round(F.expr(e), 9).alias(n) if n.endswith("share") else F.expr(e).alias(n) for n, e in text.measures("text", "kinds").items()))


@query(f"with {views.LOG} select row_id, {text.surface('query', DUCK)} as surface from log")
def surface_form(spark, sf_dir):
    return spread(views.log(spark, sf_dir)).select("row_id", F.expr(text.surface("query")).alias("surface"))


@query(f"with {views.CHAT} select id, {text.intent_cue('text', DUCK)} as intent_cue from chat")
def intent_cue(spark, sf_dir):
    return views.chat(spark, sf_dir).select("id", F.expr(text.intent_cue("text")).alias("intent_cue"))


@query(f"with {views.CORPUS} select id, {text.domain_cue(text.domain_tokens('source_text', DUCK), DUCK)} as domain_cue from corpus")
def domain_cue(spark, sf_dir):
    return views.corpus(spark, sf_dir).withColumn("t", F.expr(text.domain_tokens("source_text"))).select("id", F.expr(text.domain_cue("t")).alias("domain_cue"))


@query(f"with {views.LOG} select row_id, " + ", ".join(f"{e} as {n}" for n, e in text.profile_dimensions("query", "packages", DUCK).items()) + " from log")
def feature_buckets(spark, sf_dir):
    return text.with_dimensions(spread(views.log(spark, sf_dir)), "query", "packages").select("row_id", *text.DIMENSIONS)


@query(f"with {views.LOG}, w as (select row_id, {text.words('query', DUCK)} as n from log) select row_id, n as n_words, {text.binned('n', *text.LENGTH_BINS)} as length_bin, {text.length_class('n')} as length_class from w")
def length_bins(spark, sf_dir):
    rows = views.log(spark, sf_dir).withColumn("n", F.expr(text.words("query")))
    return rows.select("row_id", F.col("n").alias("n_words"), F.expr(text.binned("n", *text.LENGTH_BINS)).alias("length_bin"), F.expr(text.length_class("n")).alias("length_class"))


@query(f"with {views.REQUESTS}, c as (select source, strftime(day, '%A') as weekday, count(*) as n from requests group by all) select source, weekday, {numbers.rounded('n')} as rounded, {numbers.rounded('n', 1)} as plain, {numbers.safe('n')} as safe from c")
def rounded_counts(spark, sf_dir):
    c = views.requests(spark, sf_dir).groupBy("source", F.date_format("day", "EEEE").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("source", "weekday", F.expr(numbers.rounded("n")).alias("rounded"), F.expr(numbers.rounded("n", 1)).alias("plain"), F.expr(numbers.safe("n")).alias("safe"))


_GATE = """c as (select {keys}, count(*) as n from {table} group by all),
    w as (select *, row_number() over (order by n, {keys}) as r, sum(case when n < 10 then 1 else 0 end) over () as sm, count(*) over () as g from c),
    f as (select *, n < 10 or (sm = 1 and g > 2 and r = 2) as hid from w)
    select {shown}, cast(floor((n + 5) / 10.0) * 10 as bigint) as n from f where not hid
    union all select {none}, case when sum(n) >= 10 then cast(floor((sum(n) + 5) / 10.0) * 10 as bigint) end from f where hid having count(*) > 0"""


@query(f"with {views.REQUESTS}, " + _GATE.format(table="requests", keys="source, day", shown="cast(source as varchar) as source, cast(day as varchar) as day", none="'<suppressed>', '<suppressed>'"))
def gate_volume_by_source(spark, sf_dir):
    return gate.releasable_counts(views.requests(spark, sf_dir), ["source", "day"])


@query(f"with {views.LOG}, " + _GATE.format(table="log", keys="source", shown="source", none="'<suppressed>'"))
def gate_log_sources(spark, sf_dir):
    return gate.releasable_counts(views.log(spark, sf_dir), ["source"])


@query(f"with {views.LOG}, counted as (select source, {text.length_class(text.words('query', DUCK))} as category, cast(collected_on as varchar) as day, count(*) as n from log group by all), {gate.release_sql('counted', ['day'])} select * from released")
def gate_release_offline(spark, sf_dir):
    rows = views.log(spark, sf_dir).groupBy("source", F.expr(text.once(text.words("query"), text.length_class)).alias("category"), F.col("collected_on").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return gate.release(rows, ["day"])


def _profile_sql() -> str:
    dims = text.profile_dimensions("text", "packages", DUCK)
    named = ", ".join(f"{e} as {n}" for n, e in dims.items())
    result = f"case when result_count is null then 'missing' else {text.bucket('result_count', workload.RESULT_BOUNDS)} end"
    both = [*dims, "repeats"]
    cell = "select '{view}' as view, '{d}' as dimension, source, {c} as category, count(*) as n from {t} group by all".format
    parts = [cell(view="events", d=d, c=d, t="e") for d in [*both, "results", "day", "weekday", "surface_results", "intent_results"]] + [cell(view="events", d="source", c="'requests'", t="e")]
    parts += [cell(view="distinct_requests", d=d, c=d, t="o") for d in both] + [cell(view="distinct_requests", d="source", c="'requests'", t="o")]
    parts += ["select 'global', 'distinct_texts', 'all', 'distinct_texts', count(distinct norm) from k", "select 'global', 'distinct_requests', 'all', 'distinct_requests', count(distinct (norm, filters)) from k"]
    return f"""with {views.REQUESTS}, k as (select *, {_norm_sql('text', False)} as norm, {DUCK.distinct_sorted('packages')} as filters from requests),
        r as (select *, count(*) over (partition by source, norm, filters) as times, row_number() over (partition by source, norm, filters order by position) as nth from k),
        e as (select source, nth, {named}, {text.bucket('times', workload.REPEAT_BOUNDS)} as repeats, {result} as results, cast(day as varchar) as day, strftime(day, '%A') as weekday,
            {dims['surface']} || ' / ' || {result} as surface_results, {dims['intent_cue']} || ' / ' || {result} as intent_results from r),
        o as (select * from e where nth = 1), counted as ({' union all '.join(parts)}), {gate.release_sql('counted', ['view', 'dimension'])}
        select * from released"""


@query(_profile_sql())
def profile_cells(spark, sf_dir):
    return workload.profile(views.requests(spark, sf_dir))


def _workload_sql() -> str:
    cell = "select win, channel, '{m}' as measure, {c} as category, {n} as n from {t} group by all".format
    parts = [
        cell(m="requests", c="'requests'", n="sum(times)", t="g"), cell(m="repeat_accounting", c="'distinct'", n="count(*)", t="g"), cell(m="repeat_accounting", c="'extra_occurrences'", n="sum(times - 1)", t="g"),
        cell(m="frequency_events", c="case when times = 1 then 'once' when times <= 5 then '2-5' else '6+' end", n="sum(times)", t="g"),
        cell(m="recurrence_distinct", c="case when days = 1 then 'one_day' else 'multiple_days' end", n="count(*)", t="g"),
        cell(m="repeated_result_counts", c="case when unknown > 0 then 'missing' when results = 1 then 'same_count' else 'different_counts' end", n="count(*)", t="(select * from g where times >= 2)"),
    ]
    for m, c in (("surface", "surface"), ("length", "length_"), ("filters", "has")):
        parts += [cell(m=f"requests/{m}", c=c, n="count(*)", t="b"), cell(m=f"distinct/{m}", c=c, n="count(*)", t="(select * from b where nth = 1)")]
    return f"""with {views.REQUESTS}, k as (select *, {_norm_sql('text', False)} as norm, {DUCK.distinct_sorted('packages')} as filters, {text.surface('text', DUCK)} as surface,
            {text.length_class(text.words('text', DUCK))} as length_, case when len(packages) > 0 then 'with_filter' else 'without_filter' end as has from requests),
        w as (select *, 'full' as win from k union all select *, case when day = (select min(day) from k) then 'first_day' else 'later' end from k),
        c as (select *, 'all' as channel from w union all select *, 'channel:' || source from w),
        l as (select win, channel from c group by all having channel = 'all' or count(*) >= {workload.CHANNEL_ROWS}),
        b as (select c.*, row_number() over (partition by c.win, c.channel, norm, filters order by position) as nth from c join l on c.win = l.win and c.channel = l.channel),
        g as (select win, channel, norm, filters, count(*) as times, count(distinct day) as days, count(distinct result_count) as results, count(*) - count(result_count) as unknown from b group by all),
        cells as ({' union all '.join(parts)}), counted as (select *, 'all' as source from cells where n > 0 and measure <> 'requests'), {gate.release_sql('counted', ['win', 'channel', 'measure'])}
        select win, channel, measure, category, "count" from released
        union all select win, channel, measure, category, 0 from cells where n = 0 and measure <> 'requests'
        union all select win, channel, measure, category, {numbers.safe('n')} from cells where measure = 'requests'"""


@query(_workload_sql())
def workload_windows(spark, sf_dir):
    return workload.workload(views.requests(spark, sf_dir))


@query(f"with {views.REQUESTS}, k as (select *, {_norm_sql('text', False)} as norm, {DUCK.distinct_sorted('packages')} as filters from requests) select position, count(*) over (partition by source, norm, filters) as times from k")
def repeat_counts(spark, sf_dir):
    return workload.with_repeats(views.requests(spark, sf_dir)).select("position", "times")


@query(f"with {views.REQUESTS}, k as (select *, {_norm_sql('text', False)} as norm, {DUCK.distinct_sorted('packages')} as filters from requests) select source, norm, array_to_string(filters, ',') as filters, min(position) as position from k group by source, norm, k.filters")
def first_occurrences(spark, sf_dir):
    rows = workload.with_request_key(views.requests(spark, sf_dir)).select("position", "source", "norm", "filters")
    return workload._first(rows, ["source", "norm", "filters"]).select("source", "norm", F.array_join("filters", ",").alias("filters"), "position")


@query(f"with {views.REQUESTS}, counted as (select 'all' as source, cast(day as varchar) as category, count(*) as n from requests group by all), {gate.release_sql('counted', [])} select category as day, \"count\" from released")
def daily_volume(spark, sf_dir):
    counted = views.requests(spark, sf_dir).groupBy(F.lit("all").alias("source"), F.col("day").cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return gate.release(counted, []).select(F.col("category").alias("day"), "count")


@query(f"with {views.REQUESTS} select cast(min(day) as varchar) as first_day, cast(max(day) as varchar) as last_day, count(*) as rows_read, count(*) filter (where day >= date '2024-01-10') as rows_since from requests")
def load_report(spark, sf_dir):
    return views.requests(spark, sf_dir).agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count(F.lit(1)).alias("rows_read"), F.count_if(F.expr("day >= date'2024-01-10'")).alias("rows_since"))


_EXACT = f"""g as (select *, {_norm_sql('query', True)} as normalized from log), first as (select normalized, min(row_id) as root from g group by all),
    ids as (select normalized, dense_rank() over (order by root) - 1 as group_id from first), rows_ as (select g.*, ids.group_id from g join ids using (normalized)),
    t as (select group_id, normalized, count(*) as n, min(row_id) as first_row from rows_ group by all),
    best as (select group_id, arg_max(normalized, n * 1000000000000 - first_row) as query, count(*) as n_variants from t group by all),
    d as (select group_id, count(*) as n_rows, count(distinct collected_on) as n_days, array_to_string(list_sort(list(distinct source)), '+') as main_source, min(collected_on) as first_seen, max(collected_on) as last_seen,
        median(result_count)::double as median_result_count, round(avg(case when result_count = 0 then 1.0 else 0.0 end), 9) as zero_result_share, round(avg(case when len(packages) > 0 then 1.0 else 0.0 end), 9) as uses_package_filter from rows_ group by all),
    summary as (select * from best join d using (group_id))"""


def _summary(spark, sf_dir):
    grouped = groups.assign_groups(views.log(spark, sf_dir), threshold=1.0)
    return grouped, groups.summarize_groups(grouped)


@query(f"with {views.LOG}, {_EXACT} select group_id, query, n_variants, n_rows, n_days, main_source, cast(first_seen as varchar) as first_seen, cast(last_seen as varchar) as last_seen, median_result_count, zero_result_share, uses_package_filter from summary")
def distinct_summary(spark, sf_dir):
    s = _summary(spark, sf_dir)[1].withColumn("main_source", F.array_join("sources", "+")).drop("sources")
    return s.withColumns({c: F.round(c, 9) for c in ("zero_result_share", "uses_package_filter")}).withColumns({"median_result_count": F.col("median_result_count").cast("double"), "first_seen": F.col("first_seen").cast("string"), "last_seen": F.col("last_seen").cast("string")})


@query(f"with {views.LOG}, {_EXACT} select row_id, group_id, n_rows as group_rows, len(packages) > 0 as has_package_filter, n_rows > 1 as in_repeated_group from rows_ join summary using (group_id)")
def rows_with_groups(spark, sf_dir):
    grouped, s = _summary(spark, sf_dir)
    rows = grouped.join(s.select("group_id", F.col("n_rows").alias("group_rows")), "group_id")
    return rows.select("row_id", "group_id", "group_rows", (F.size("packages") > 0).alias("has_package_filter"), (F.col("group_rows") > 1).alias("in_repeated_group"))


@query(f"with {views.LOG}, {_EXACT}, b as (select {text.binned('n_rows', *text.REPEAT_BINS)} as repeat_bin, {text.binned(text.words('query', DUCK), *text.LENGTH_BINS)} as length_bin from summary), r as (select unnest([{', '.join(repr(x) for x in text.REPEAT_BINS[1])}]) as repeat_bin), l as (select unnest([{', '.join(repr(x) for x in text.LENGTH_BINS[1])}]) as length_bin), grid as (select * from r, l), n as (select repeat_bin, length_bin, count(*) as n from b group by all) select grid.repeat_bin, grid.length_bin, coalesce(n, 0) as n from grid left join n using (repeat_bin, length_bin) union all select repeat_bin, length_bin, n from n where repeat_bin is null or length_bin is null")
def counts_with_empty_bins(spark, sf_dir):
    """Counts of two ordered bins; bins without rows are kept, unknown ones are groups of their own."""
    s = _summary(spark, sf_dir)[1]
    binned = s.select(F.expr(text.binned("n_rows", *text.REPEAT_BINS)).alias("repeat_bin"), F.expr(text.once(text.words("query"), lambda n: text.binned(n, *text.LENGTH_BINS))).alias("length_bin"))
    return report.counts_with_empty(binned, {"repeat_bin": text.REPEAT_BINS[1], "length_bin": text.LENGTH_BINS[1]})


def _overview_sql() -> str:
    def share(cond: str) -> str:
        return f"round({numbers.rounded(f'count(*) filter (where {cond})')}::double / nullif({numbers.rounded('count(*)')}, 0), 9)"

    return f"""with {views.LOG}, {_EXACT}, p as (select rows_.*, n_rows from rows_ join summary using (group_id))
        select {numbers.rounded('count(*)')} as rows, {numbers.rounded('count(distinct group_id)')} as distinct_queries, count(distinct collected_on) as days,
        {share('n_rows > 1')} as share_rows_in_repeated_groups, {share('result_count = 0')} as zero_result_share, {share('len(packages) > 0')} as package_filter_share from p"""


@query(_overview_sql())
def overview(spark, sf_dir):
    """Headline numbers; shares come from rounded counts."""
    return report.overview(views.log(spark, sf_dir))


_OVERVIEW = ("rows", "distinct_queries", "days", "share_rows_in_repeated_groups", "zero_result_share", "package_filter_share")


@query(f"with o as ({_overview_sql()}) " + " union all ".join(f"select '{c}' as measure, " + (f"printf('%.2f%%', 100 * {c})" if c.endswith("share") or c.startswith("share") else f"format('{{:,}}', {c})") + " as value from o" for c in _OVERVIEW))
def overview_table(spark, sf_dir):
    return report.formatted(report.overview(views.log(spark, sf_dir)))


@query(f"with {views.LOG}, {_EXACT} select group_id, query, n_rows from summary order by n_rows desc, group_id limit 20")
def most_repeated(spark, sf_dir):
    return report.most_repeated(_summary(spark, sf_dir)[1])


_SHORT = "short as (select item_id as id, 'b' as source, cast(item_id % 3 as varchar) as collected_on, regexp_replace(trim(text), '\\s+', ' ', 'g') as normalized from benchmark union all select 100000 + item_id, 'b', cast(item_id % 3 as varchar), regexp_replace(trim(text), '\\s+', ' ', 'g') || ' again' from benchmark)"
_PAIRS = f"""{_SHORT}, s as (select id, collected_on, case when length(normalized) <= 4 then [normalized] else list_distinct(list_transform(range(1, length(normalized) - 2), lambda i: substr(normalized, i, 4))) end as s from short),
    pairs as (select a.id as a, b.id as b, len(list_intersect(a.s, b.s))::double / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) as similarity from s a join s b on a.collected_on = b.collected_on and a.id < b.id)"""


def _short(spark, sf_dir):
    b = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("source"), F.expr("cast(item_id % 3 as string)").alias("collected_on"), F.expr(r"regexp_replace(trim(text), '\\s+', ' ')").alias("normalized"))
    return b.unionByName(b.withColumn("id", F.col("id") + 100000).withColumn("normalized", F.concat("normalized", F.lit(" again"))))


@query(f"with {_PAIRS} select a, b, round(similarity, 9) as similarity from pairs where similarity >= 0.7")
def shingle_jaccard_pairs(spark, sf_dir):
    return groups.similar_pairs(_short(spark, sf_dir), ["source", "collected_on"], 0.7).select("a", "b", F.round("similarity", 9).alias("similarity"))


_DUP = f"""with recursive {_PAIRS}, first as (select normalized, min(id) as node from short group by all),
    link as (select fa.node as a, fb.node as b from pairs join short x on x.id = pairs.a join short y on y.id = pairs.b join first fa on fa.normalized = x.normalized join first fb on fb.normalized = y.normalized where similarity >= 0.7),
    sym as (select a, b from link union select b, a from link), reach as (select node as a, node as b from first union select reach.a, sym.b from reach join sym on reach.b = sym.a),
    root as (select a as node, min(b) as root from reach group by a), ids as (select node, dense_rank() over (order by root) - 1 as group_id from root)
    select short.id as row_id, group_id from short join first using (normalized) join ids using (node)"""


@query(_DUP)
def dup_groups(spark, sf_dir):
    rows = _short(spark, sf_dir).select(F.col("id").alias("row_id"), F.col("normalized").alias("query"), "source", "collected_on")
    return groups.assign_groups(rows, threshold=0.7).select("row_id", "group_id")


@query(_DUP.replace("select short.id as row_id, group_id from", "select group_id, count(*) as n_rows, count(distinct normalized) as n_variants, arg_min(normalized, id) as first_text from") + " group by group_id")
def distinct_queries_near(spark, sf_dir):
    rows = _short(spark, sf_dir).select(F.col("id").alias("row_id"), F.col("normalized").alias("query"), "source", "collected_on")
    grouped = groups.assign_groups(rows, threshold=0.7)
    return grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("normalized").alias("n_variants"), F.min_by("normalized", "row_id").alias("first_text"))


#: Near-duplicates of the whole log, at the reference's threshold; the SQL compares all pairs, which suits small tables only.
NEAR = 0.8
_LOG_PAIRS = f"""{views.LOG}, g as (select *, {_norm_sql('query', True)} as normalized from log), first as (select normalized, min(row_id) as node from g group by all),
    one as (select distinct source, collected_on, normalized from g),
    s as (select node as id, source, collected_on, case when length(normalized) <= 4 then [normalized] else list_distinct(list_transform(range(1, length(normalized) - 2), lambda i: substr(normalized, i, 4))) end as s from one join first using (normalized)),
    sized as (select *, len(s) as n from s),
    met as (select a.id as a, b.id as b, a.n as na, b.n as nb, len(list_intersect(a.s, b.s)) as common from sized a join sized b on a.source = b.source and a.collected_on = b.collected_on and a.id < b.id and least(a.n, b.n) >= 0.79 * greatest(a.n, b.n)),
    pairs as (select distinct a, b, common::double / (na + nb - common) as similarity from met where common::double / (na + nb - common) >= {NEAR})"""
_LOG_GROUPS = f"""{_LOG_PAIRS}, sym as (select a, b from pairs union select b, a from pairs), reach as (select node as a, node as b from first union select reach.a, sym.b from reach join sym on reach.b = sym.a),
    root as (select a as node, min(b) as root from reach group by a), ids as (select node, dense_rank() over (order by root) - 1 as group_id from root),
    rows_ as (select g.*, group_id from g join first using (normalized) join ids using (node))"""


def _near_groups(spark, sf_dir):
    return groups.assign_groups(views.log(spark, sf_dir), threshold=NEAR)


@query(f"with {_LOG_PAIRS} select a, b, round(similarity, 9) as similarity from pairs")
def log_near_pairs(spark, sf_dir):
    """Pairs of distinct texts of one source and day, each by its first row, with a Jaccard similarity of 0.8 or more."""
    marked = materialize(groups.keyed(views.log(spark, sf_dir)), "normalized")
    texts = groups.distinct_texts(marked, "source", "collected_on")
    return groups.similar_pairs(texts, ["source", "collected_on"], NEAR).select("a", "b", F.round("similarity", 9).alias("similarity")).distinct()


@query(f"with recursive {_LOG_GROUPS} select row_id, group_id from rows_")
def log_near_groups(spark, sf_dir):
    return _near_groups(spark, sf_dir).select("row_id", "group_id")


@query(f"with recursive {_LOG_GROUPS} select group_id, count(*) as n_rows, count(distinct normalized) as n_variants, count(distinct collected_on) as n_days, arg_min(normalized, row_id) as first_text from rows_ group by group_id")
def log_near_summary(spark, sf_dir):
    grouped = _near_groups(spark, sf_dir)
    return grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.sha2(F.encode("normalized", "utf-8"), 256)).alias("n_variants"), F.countDistinct("collected_on").alias("n_days"), F.min_by("normalized", "row_id").alias("first_text"))


@query(f"""with {views.LOG}, f as (select source, {_norm_sql('query', False)} as norm, {DUCK.distinct_sorted('packages')} as filters, arg_min(query, row_id) as query from log group by all),
    s as (select source, {text.surface('query', DUCK)} as surface, count(*) as n from f group by all), slots as (select source, surface, n, unnest(range(1, n + 1)) as slot from s),
    taken as (select source, surface from slots order by slot, source, surface limit 150)
    select s.source, s.surface, s.n, count(taken.source) as quota from s left join taken using (source, surface) group by all""")
def stratified_quota(spark, sf_dir):
    rows = views.log(spark, sf_dir).select(F.col("row_id").alias("position"), "source", F.col("query").alias("text"), "packages")
    first = workload._first(workload.with_request_key(rows).select("position", "source", "norm", "filters", "text"), ["source", "norm", "filters"])
    strata = first.groupBy("source", F.expr(text.surface("text")).alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.quotas(strata, ["source", "surface"], 150)


@query()
def review_sample(spark, sf_dir):
    rows = views.log(spark, sf_dir).select(F.col("row_id").alias("position"), "source", F.col("query").alias("text"), "packages")
    return sampling.review_sample(rows, 150)


_AXES = {  # what made-up labels hold, by number; the last of each is no value of its axis
    "intent": (*sampling.AXES["intent"], "guess"), "actor": (*sampling.AXES["actor"], "robot"), "certainty": (*sampling.AXES["certainty"], "sure"),
    "evidence": sampling.AXES["evidence"], "language": (*sampling.AXES["language"], "de"), "expected_output": (*sampling.AXES["expected_output"], "poem"),
}
_LABELS = {a: f"case {' '.join(f'when (doc_id * {7 + 2 * i}) % {len(values)} = {j} then {chr(39)}{v}{chr(39)}' for j, v in enumerate(values))} end" for i, (a, values) in enumerate(_AXES.items())}
_LABELS["evidence"] = f"case when doc_id % 23 <> 0 then {_LABELS['evidence']} end"


@query(
    "with a as (select doc_id as position, " + ", ".join(f"{e} as {n}" for n, e in _LABELS.items()) + " from documents) "
    + " union all ".join(f"select position, 'unknown {a}' as error from a where {a} is null or {a} not in {values}" for a, values in sampling.AXES.items())
    + " union all select position, 'actor without evidence' from a where actor <> 'unknown' and (evidence is null or evidence = 'annotator_inference')"
)
def review_label_validation(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return sampling.label_errors(d.select(F.col("doc_id").alias("position"), *(F.expr(e).alias(n) for n, e in _LABELS.items())))


@query(f"with {views.REQUESTS}, w as (select position, source, row_number() over (partition by source order by result_count desc nulls last, position) as r from requests) select source, r as place, position from w where r <= 5")
def top_per_source(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("result_count"), "position")
    return views.requests(spark, sf_dir).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("source", "place", "position")


@query(f"with {views.LOG} select row_id, replace(lower({_norm_sql('query', True)}), 'ß', 'ss') as folded from log")
def normalize_casefold(spark, sf_dir):
    """The log's normal form with its case folded; of the letters of these texts only ß folds to something else than its small letter."""
    return groups.with_normal_form(spread(views.log(spark, sf_dir)), folded=True).select("row_id", F.col("normalized").alias("folded"))


@query(f"with {views.REQUESTS}, g as (with c as (select source, day, count(*) as n from requests group by all), w as (select *, row_number() over (order by n, source, day) as r, sum(case when n < 10 then 1 else 0 end) over () as sm, count(*) over () as cells from c) select cast(source as varchar) as source, cast(day as varchar) as day, cast(floor((n + 5) / 10.0) * 10 as bigint) as n from w where not (n < 10 or (sm = 1 and cells > 2 and r = 2))) select * from g")
def gate_shown_cells(spark, sf_dir):
    """The gated volume without its pooled row, as a heat map shows it."""
    return gate.shown(gate.releasable_counts(views.requests(spark, sf_dir), ["source", "day"]))


@query("select count(*) as requests, sum(o_orderkey)::bigint as prompt_tokens, sum(o_custkey)::bigint as completion_tokens, round(sum(o_totalprice), 2) as cost from orders")
def usage_totals(spark, sf_dir):
    calls = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_tokens"), F.col("o_custkey").alias("completion_tokens"), F.col("o_totalprice").alias("cost"))
    return report.usage_totals(calls).withColumn("cost", F.round("cost", 2))


@query(f"with {views.LOG} select source, least(count(*), 7) as n, least(count(*), 7) as members from log group by source")
def sample_per_source(spark, sf_dir):
    """Sizes of a fixed-size sample of each source; the members are chosen by hash, and are rows of that source."""
    rows = views.log(spark, sf_dir).select("row_id", "source")
    picked = sampling.group_sample(rows, ["source"], "row_id", 7)
    known = picked.join(rows.select("row_id", F.col("source").alias("own")), "row_id")
    return known.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") == F.col("source")).alias("members"))


@query(f"with {views.LOG} select cast(floor(0.8 * count(*)) as bigint) as n, cast(floor(0.8 * count(*)) as bigint) as rows from log")
def subsample_size(spark, sf_dir):
    """A subsample of four fifths without replacement: its size, and how many different rows it holds."""
    return clusters.subsample(views.log(spark, sf_dir).select("row_id"), "row_id", 3).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("rows"))


@query("select r.repetition, count(*) as cases, count(*) as places, 1::bigint as first_place, count(*) as last_place from nation, (select unnest([0, 1, 2]) as repetition) r group by r.repetition")
def run_order(spark, sf_dir):
    """Cases shuffled anew in each repetition: every place is taken once."""
    cases = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("q"))
    placed = sampling.run_order(cases, ["q"], 3)
    return placed.groupBy("repetition").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("place").alias("places"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


_QUOTAS = f"""with {views.LOG}, f as (select source, {_norm_sql('query', False)} as norm, {DUCK.distinct_sorted('packages')} as filters, arg_min(query, row_id) as query from log group by all),
    s as (select source, {text.surface('query', DUCK)} as surface, count(*) as n from f group by all), slots as (select source, surface, n, unnest(range(1, n + 1)) as slot from s),
    taken as (select source, surface, n from slots order by slot, source, surface limit 150)"""


@query(_QUOTAS + " select source, surface, n as population, count(*) as sampled, count(*) as rows from taken group by all")
def review_sample_sizes(spark, sf_dir):
    """Of the review sample each stratum's population and size; its annotations find them by position."""
    rows = views.log(spark, sf_dir).select(F.col("row_id").alias("position"), "source", F.col("query").alias("text"), "packages")
    sample = sampling.review_sample(rows, 150)
    return sampling.with_strata(sample.select("position"), sample).groupBy("source", "surface", "population", "sampled").agg(F.count(F.lit(1)).alias("rows"))


@query("select count(*) as n, count(*) as near, true as moved from lineitem")
def jittered_points(spark, sf_dir):
    """Points moved by at most a hundredth of the range of each axis."""
    line = views.table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    moved = clusters.jittered(line.withColumns({"x0": F.col("x"), "y0": F.col("y")}), ["x", "y"], "id")
    r = moved.crossJoin(line.agg((F.max("x") - F.min("x")).alias("rx"), (F.max("y") - F.min("y")).alias("ry")))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("abs(x - x0) <= 0.0101 * rx and abs(y - y0) <= 0.0101 * ry")).alias("near"), (F.count_if(F.expr("x <> x0")) > 0).alias("moved"))
