import datetime
import json
import sqlite3

import pytest

from querylens import cli
from querylens.sources import export, files, judgments, log
from querylens.streaming import daily

KEY = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="


def record(**more):
    return {"query": "x", "package_filters": [], "result_count": 1, "collected_on": "2024-01-01"} | more


def put(tmp_path, value):
    p = tmp_path / "export.json"
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


def test_export(spark, tmp_path):
    path = put(tmp_path, {"api": [record(query=""), record(result_count=None, collected_on="2024-01-03")], "web": [record(package_filters=["a"])]})
    got = export.load_export(spark, path).orderBy("position").collect()
    assert [(r["position"], r["source"], r["text"], r["packages"], r["result_count"]) for r in got] == [(1, "web", "x", ["a"], 1), (2, "api", "", [], 1), (3, "api", "x", [], None)]
    assert export.load_export(spark, path, "2024-01-02").count() == 1


@pytest.mark.parametrize("bad", [record(query=None), record(package_filters="a"), record(package_filters=[1]), record(package_filters=[""]), record(result_count=True), record(result_count=-1), record(result_count=2.5), record(collected_on="20240101"), record(collected_on="soon"), {"query": "x"}, None])
def test_bad_records(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="position 2"):
        export.load_export(spark, put(tmp_path, {"api": [record(collected_on="2020-01-01"), bad]}), "2024-01-01")


@pytest.mark.parametrize("bad", [[], {"other": []}, {"api": {}}, "{"])
def test_bad_exports(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        export.load_export(spark, put(tmp_path, bad))


def test_sqlite(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps({"q": f"q{i}"})) for i in range(1, 21)], "id int, p string").withColumn("t", log.encrypted("p", KEY, "unhex('000102030405060708090a0b0c0d0e0f')")).collect()
    path = str(tmp_path / "log.db")
    with sqlite3.connect(path) as c:
        c.execute(f"create table {log.TABLE} (id integer primary key, encrypted_query_data text not null, source varchar(16) not null, result_count integer, collected_on date not null)")
        c.executemany(f"insert into {log.TABLE} values (?, ?, 'web', null, ?)", [(r["id"], r["t"] if r["id"] != 7 else "junk", f"2024-01-{r['id']:02d}") for r in rows])
    loaded, report = log.load_log(log.read_sqlite(spark, path), KEY)
    assert loaded.count() == 19 and tuple(report.first()) == (20, 19, 1)
    assert loaded.agg({"collected_on": "max"}).first()[0] == datetime.date(2024, 1, 20)
    assert log.load_log(log.read_sqlite(spark, path, since="2024-01-15"), KEY)[0].count() == 6


def collection():
    return {"corpus_revision": "r", "queries": [{"id": "1", "group_id": "a", "track": "human", "answerability": "answerable", "judgments": {"x": 3, "y": 1}, "premise_routes": [[["x"]]]}, {"id": "2", "group_id": "b", "track": "agent", "answerability": "unanswerable", "judgments": {}}, {"id": "3", "group_id": "c", "track": "human", "answerability": "answerable", "judgments": {"z": 2}}]}


def run(**results):
    return {"name": "n", "corpus_revision": "r", "max_k": 5, "results": {"1": {"status": "ok", "documents": ["x", "y"], "latency_ms": 3.0}, "2": {"status": "ok", "documents": [], "abstained": True}} | results}


def test_evaluate_and_compare(spark, tmp_path, capsys):
    paths = {}
    for name, value in (("c", collection()), ("a", run()), ("b", run(**{"3": {"status": "ok", "documents": ["z"]}}))):
        paths[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert cli.main(["evaluate", paths["c"], paths["a"], "--cutoffs", "1", "10"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    means = {(m["track"], m["metric"]): (m["mean"], m["n"]) for m in out["metrics"]}
    assert means["all", "success@1"] == (0.5, 2) and means["all", "request_success"] == (pytest.approx(2 / 3), 3) and means["all", "correct_abstention"] == (1, 1)
    assert not any(m.endswith("@10") for _, m in means)
    assert cli.main(["compare", paths["c"], paths["a"], paths["b"], "--metric", "success@1", "--samples", "100"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["n_queries"] == 2 and out["candidate_minus_baseline"] == 0.5


def test_run_rules(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(collection()))
    (tmp_path / "r.json").write_text(json.dumps(run(**{"3": {"status": "error", "documents": ["z"]}}) | {"corpus_revision": "other"}))
    q, qrels, routes = judgments.read_collection(spark, str(tmp_path / "c.json"))
    results, ranked = judgments.read_run(spark, str(tmp_path / "r.json"))
    got = {r["rule"]: r["violations"] for r in judgments.problems(q, qrels, routes, results, ranked).collect()}
    assert got["corpus revisions differ"] == 3 and got["failed request with documents"] == 1 and got["route through a document that is not relevant"] == 0


def test_pilot_rules(spark, tmp_path):
    good = {"id": "1", "query": "x", "category": "c", "relevant": ["a"]}
    p = tmp_path / "p.json"
    p.write_text(json.dumps([good]))
    assert judgments.read_pilot(spark, str(p)).count() == 1
    for bad in ([good, good], [good | {"relevant": []}], [good | {"relevant": ["a", "a"]}], [good | {"query": " "}]):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            judgments.read_pilot(spark, str(p))


def test_build_and_files(spark, tmp_path):
    path = put(tmp_path, {"api": [record(query=f"<b>{i % 20}") for i in range(120)]})
    assert cli.main(["build", path, "--out", str(tmp_path / "out")]) == 0
    page = (tmp_path / "out" / "index.html").read_text()
    assert "120" in page and "<b>" not in page
    sha = files.fingerprints(spark, path).first()["sha256"]
    assert sha in (tmp_path / "out" / "manifest.json").read_text()


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    q = daily.daily_volume(spark.readStream.schema(events.schema).parquet(src)).writeStream.outputMode("append").format("memory").queryName("volume").start()
    try:
        q.processAllAvailable()
        closed = {(r["day"], r["event_type"]): r["n"] for r in spark.sql("select * from volume").collect()}
    finally:
        q.stop()
    whole = {(r["day"], r["event_type"]): r["n"] for r in daily.daily_volume(events).collect()}
    assert closed and all(whole[k] == n for k, n in closed.items())


def test_hashes_stay_with_their_files_where_one_task_reads_several(spark, tmp_path):
    import hashlib

    want = {}
    for i in range(20):
        (tmp_path / f"f{i}.json").write_text(f'{{ "b":1,\n"a": {i}}}' if i != 7 else "{")
        want[f"f{i}.json"] = hashlib.sha256(f'{{"a": {i}, "b": 1}}'.encode()).hexdigest() if i != 7 else None
    got = files.canonical_hashes(spark, str(tmp_path)).collect()
    assert len(got) == 20 and {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in got} == want
