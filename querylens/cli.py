"""Commands: report and explore (a stored log), build, audit and review (an export), evaluate and compare (ranked runs), holm."""

from __future__ import annotations

import argparse
import json
import pathlib

from pyspark.sql import DataFrame, SparkSession

from .operators import gate, groups, inference, ranking, report, sampling, workload
from .sources import export, files, judgments, log, server, settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="querylens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "audit"):
        b = sub.add_parser(name, help="gated tables of a JSON export")
        b.add_argument("input")
        b.add_argument("--since")
        b.add_argument("--min-count", type=int, default=10)
        b.add_argument("--out", required=True)
    for name in ("report", "explore"):
        r = sub.add_parser(name, help="gated tables of a stored log" if name == "report" else "the same page, ungated, on this machine's loopback address")
        r.add_argument("--database")
        r.add_argument("--env-file")
        r.add_argument("--since")
        r.add_argument("--threshold", type=float, default=0.8)
        r.add_argument("--out", required=name == "report")
        r.add_argument("--port", type=int, default=8050)
    v = sub.add_parser("review", help="label a sample of an export on this machine's loopback address")
    v.add_argument("input")
    v.add_argument("--out", required=True)
    v.add_argument("--reviewer", required=True)
    v.add_argument("--size", type=int, default=400)
    v.add_argument("--seed", type=int, default=42)
    v.add_argument("--port", type=int, default=8051)
    h = sub.add_parser("holm", help="adjust p-values of several comparisons")
    h.add_argument("p", type=float, nargs="+")
    e = sub.add_parser("evaluate", help="score a run against a collection")
    e.add_argument("collection")
    e.add_argument("run")
    e.add_argument("--cutoffs", type=int, nargs="+", default=[1, 5, 10, 20, 50, 100])
    c = sub.add_parser("compare", help="compare two runs on one metric")
    c.add_argument("collection")
    c.add_argument("baseline")
    c.add_argument("candidate")
    c.add_argument("--metric", required=True)
    c.add_argument("--track", default="all", choices=["all", "human", "agent", "unknown"])
    c.add_argument("--samples", type=int, default=10_000)
    c.add_argument("--seed", type=int, default=42)
    return p


def _scores(spark: SparkSession, collection: str, run: str, cutoffs: tuple[int, ...]) -> dict:
    """Scores of a run and all that says whether they may be compared with another's."""
    queries, qrels, routes = judgments.read_collection(spark, collection)
    results, ranked = judgments.read_run(spark, run)
    scheduled = judgments.scheduled(queries, results)
    broken = judgments.problems(queries, qrels, routes, results, ranked).where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))
    ranking.check(scheduled, ranked, qrels)
    deepest = results.agg({"max_k": "max"}).first()[0]
    first = queries.select("corpus_revision").first()
    hashes = {n: files.canonical_hashes(spark, p).first()["sha256"] for n, p in (("run_sha256", run), ("collection_sha256", collection))}
    return {"queries": scheduled, "qrels": qrels, "scores": ranking.query_scores(scheduled, ranked, qrels, cutoffs, deepest, routes), "revision": first and first[0], "unavailable_cutoffs": ranking.unavailable(cutoffs, deepest), **hashes}


def _report(spark: SparkSession, args: argparse.Namespace, base: int) -> dict[str, DataFrame]:
    """The sections of a stored log's report; base 1 and a gate of one row for the driver's own eyes."""
    key = settings.resolved(spark, settings.KEY, args.env_file)
    stored = log.read_sqlite(spark, settings.database_path(args.database), args.since)
    rows, loaded = log.load_log(stored, key, args.since)
    prepared, distinct = groups.prepare(rows, args.threshold, fit=True)
    least = 10 if base > 1 else 1
    counted = {n: gate.releasable_counts(prepared, by, least, base) for n, by in (("volume", ["collected_on", "source"]), ("categories", ["category"]), ("lengths", ["length_bin"]))}
    return {"loaded": loaded, "overview": report.formatted(report.overview(rows, base)), **counted, "category_profiles": report.describe_categories(distinct, least)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("build", "audit"):
        rows = export.load_export(spark, args.input, args.since)
        tables = {"profile": workload.profile(rows, args.min_count)}
        if args.command == "build":
            tables["workload"] = workload.workload(rows)
            tables["volume"] = gate.releasable_counts(rows, ["source", "day"], args.min_count)
        for name, df in tables.items():
            files.write_csv(df, f"{args.out}/{name}", df.columns)
        if "://" not in args.out:
            out = pathlib.Path(args.out)
            (out / "index.html").write_text(files.page(tables), encoding="utf-8")
            (out / "counts.json").write_text(files.as_json([r.asDict() for r in tables["profile"].orderBy(*tables["profile"].columns).collect()]), encoding="utf-8")
            (out / "manifest.json").write_text(files.manifest(spark, args.input, min_count=args.min_count, rounding_base=10, since=args.since), encoding="utf-8")
    elif args.command == "report":
        for name, df in (tables := _report(spark, args, 10)).items():
            files.write_csv(df, f"{args.out}/{name}", df.columns)
        if "://" not in args.out:
            (pathlib.Path(args.out) / "index.html").write_text(files.page(tables), encoding="utf-8")
    elif args.command == "explore":
        with server.page_server(files.page(_report(spark, args, 1)), args.port) as s:
            s.serve_forever()
    elif args.command == "review":
        rows = export.load_export(spark, args.input)
        picked = sampling.review_sample(rows, args.size, args.seed).join(rows.select("position", "text"), "position").orderBy("position")
        metadata = {"input_sha256": files.fingerprints(spark, args.input).first()["sha256"], "reviewer": args.reviewer, "seed": args.seed, "requested_size": args.size, "schema_version": 1}
        with server.review_server([r.asDict() for r in picked.collect()], metadata, args.out, args.port) as s:
            s.serve_forever()
    elif args.command == "holm":
        p = spark.createDataFrame(list(enumerate(args.p)), "id int, p double")
        print(json.dumps([r["adjusted"] for r in inference.holm(p).orderBy("id").collect()]))
    elif args.command == "evaluate":
        x = _scores(spark, args.collection, args.run, tuple(args.cutoffs))
        summary, costs = ranking.track_summary(x["queries"], x["scores"]), ranking.track_costs(x["queries"])
        fixed = {"corpus_revision": x["revision"], "gain": "linear", "binary_relevance_threshold": ranking.RELEVANT, **{k: x[k] for k in ("run_sha256", "collection_sha256", "unavailable_cutoffs")}}
        print(json.dumps({**fixed, "metrics": [r.asDict() for r in summary.orderBy("track", "metric").collect()], "costs": [r.asDict() for r in costs.orderBy("track").collect()]}))
    else:
        k = (int(args.metric.rpartition("@")[2]),) if "@" in args.metric else ()
        a, b = (_scores(spark, args.collection, run, k) for run in (args.baseline, args.candidate))
        inference.check_comparable(a["queries"], b["queries"], a["qrels"], b["qrels"], (a["revision"], b["revision"]))
        groups_ = inference.paired(a["queries"], a["scores"], b["scores"], args.metric, args.track)
        interval, p = inference.bootstrap_interval(groups_, args.samples, args.seed).first(), inference.sign_randomization(groups_, args.samples, args.seed).first()
        print(json.dumps({**inference.effect(groups_).first().asDict(), "track": args.track, "ci95": [interval["low"], interval["high"]], "p": p["p"], "samples": args.samples, "seed": args.seed}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
