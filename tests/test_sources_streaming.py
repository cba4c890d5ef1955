import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftloom.functions import exprs as X
from driftloom.operators import cycles, delta, experiments, graph, pixels, series
from driftloom.plans import catalog
from driftloom.registry import Registry
from driftloom.sources import logs
from driftloom.streaming import events as T


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_change_logs(spark):
    got = logs.name_status(lines(spark, "M\tcore/a.py", "R100\told.py\tnew.py", "A\tdocs/x.md", ""))
    assert rows(got) == [("A", "docs/x.md", "docs/x.md"), ("M", "core/a.py", "core/a.py"), ("R", "old.py", "new.py")]
    z = spark.createDataFrame([(1, "M\0a\0R90\0b\0c\0A\0a\0")], "id int, value string")
    assert rows(logs.name_status_z(z)) == [(1, 0, "M", "a"), (1, 1, "R", "c")]
    assert rows(logs.numstat(lines(spark, "12\t3\tcore/a.py", "-\t-\timg.png", "x"))) == [(12, 3, "core/a.py", False), (None, None, "img.png", True)]
    assert rows(logs.shortstat(lines(spark, " 3 files changed, 10 insertions(+), 2 deletions(-)", " 1 file changed, 1 deletion(-)"))) == [(1, 0, 1), (3, 10, 2)]


def test_reports(spark):
    assert rows(logs.measures(lines(spark, '{"files": {"a": 1, "b": "x"}}', '{"c": 2.5}'))) == [("a", 1.0), ("c", 2.5)]
    assert rows(logs.report_churn(lines(spark, '{"files": [{"path": "a", "loc": {"add": 3, "del": 1}}, {"path": "b"}]}'))) == [("a", 4), ("b", 0)]
    sarif = {"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "r", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 3}}}]}]}]}
    assert rows(logs.findings(lines(spark, json.dumps(sarif)))) == [("t", "r", "HIGH", "f", 3, "m")]


def test_event_history(spark, tmp_path):
    e = spark.createDataFrame([("1", dt.datetime(2024, 1, 1), "a"), ("2", dt.datetime(2024, 1, 2), "b")], "id string, ts timestamp, topic string")
    logs.append_events(e, f"{tmp_path}/h")
    assert rows(spark.read.parquet(f"{tmp_path}/h").filter("date = '2024-01-02'").select("id")) == [("2",)]
    logs.report(e, f"{tmp_path}/r", "v1")
    assert spark.read.parquet(f"{tmp_path}/r").select("digest").distinct().count() == 2
    e.createOrReplaceTempView("log")
    assert rows(logs.query(spark, "select id from log where topic = :t", t="a")) == [("1",)]


def test_payloads(spark):
    df = spark.createDataFrame([("analytics.delta.ready", '{"delta_report": {}, "paths": {"metrics": 7}}'), ("analytics.delta.ready", '{"delta_report": {}, "paths": {"metrics": "m"}}'), ("nobody", "{}"), ("analytics.scope.ready", "[1]"), ("analytics.invariants.violation", '{"level": true}')], "topic string, payload string")
    got = [r["e"] for r in df.select(X.payload_errors("topic", "payload").alias("e")).collect()]
    assert got == [["paths.metrics is not string"], [], ["unknown topic"], ["payload is not an object"], ["level is not string", "missing score", "missing delta_report"]]


def test_routing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "topic string, n int")
    T.route(df, F.col("n") > 0, f"{tmp_path}/good", f"{tmp_path}/bad")
    assert spark.read.json(f"{tmp_path}/good").count() == 1 and spark.read.json(f"{tmp_path}/bad").count() == 1


def test_unfinished_starts(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    a = spark.createDataFrame([(1, at(0)), (2, at(0))], "k int, ts timestamp")
    b = spark.createDataFrame([(1, at(5)), (2, at(30))], "k int, ts timestamp")
    assert [(r["k"], r["end_ts"] is not None) for r in T.unfinished(a, b, "k", "10 minutes").orderBy("k").collect()] == [(1, True), (2, False)]


def test_source_tokens(spark):
    df = spark.createDataFrame([("def foo(a,b):\n  pass\ndef gone():\n", "import os\ndef foo(a,b,c):\n  pass\ndef new():\n")], "old string, new string")
    got = [tuple(x) for x in df.select(delta.source_tokens(F.col("old"), F.col("new")).alias("t")).first()["t"]]
    assert got == [("ΔIMPORT", "import os"), ("ADD_FN", "new"), ("DEL_FN", "gone"), ("MODIFY_SIG", "foo")]


def test_graph_on_a_bridge(spark):
    """Two cliques of four with one bridge."""
    cliques = [(a, b) for base in (0, 4) for a in range(base, base + 4) for b in range(base, base + 4) if a < b]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in [*cliques, (3, 4)]], "src long, dst long, weight double")
    n = spark.createDataFrame([(k, "module", str(k)) for k in range(9)], "id long, kind string, label string")
    labels = {r["id"]: r["community"] for r in graph.label_propagation(n, e).collect()}
    assert len({labels[k] for k in range(4)}) == 1 and len({labels[k] for k in range(4, 8)}) == 1 and labels[0] != labels[5] and labels[8] == 8
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    src = n.filter("id < 8").select(F.col("id").alias("source"), "id")
    b = {r["id"]: r["betweenness"] for r in graph.betweenness(src, both, n).collect()}
    assert b[3] == pytest.approx(1.0) and b[4] == pytest.approx(1.0) and b[0] == 0 and b[8] == 0
    assert graph.pagerank(n, both).agg(F.sum("rank")).first()[0] == pytest.approx(1.0, abs=1e-9)
    assert cycles.components(e).count() == 0 and cycles.components(both).count() == 8
    assert {r["component"] for r in graph.connected(n, e).collect()} == {0, 8}


def test_images(spark):
    px = spark.createDataFrame([(1, x, y, (x + y) / 16) for x in range(8) for y in range(8)], "image int, x int, y int, g double")
    same = pixels.pairs(px, px)
    assert pixels.ssim(same, 8, 8).first()["ssim"] == pytest.approx(1.0) and pixels.psnr(same).first()["psnr"] == float("inf")


def test_experiments(spark):
    c = spark.createDataFrame([(8, 2), (0, 0), (600, 500)], "wins long, losses long")
    p = {r["wins"]: r["p_one_sided"] for r in experiments.sign_test(c).collect()}
    assert p[8] == pytest.approx(56 / 1024) and p[0] == 1 and 0.0013 < p[600] < 0.0015
    v = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 0.0), ("y", 1.0)], "a string, v double")
    assert experiments.cliffs_delta(v, "a", "v", "x", "y").first()["delta"] == pytest.approx((3 - 0) / 4)
    ci = experiments.bootstrap_ci(spark.range(100).selectExpr("cast(id as double) as v"), "v", 300).first()
    assert ci["low"] < 49.5 < ci["high"] and ci["high"] - ci["low"] < 16


def test_drift_fires_once(spark):
    s = spark.createDataFrame([("m", k, 0.0 if k < 50 else 1.0) for k in range(70)], "m string, k int, x double")
    d = series.page_hinkley(s, "m", "k", "x", 0.05, 3.0).filter("drift").agg(F.min("k")).first()[0]
    assert 50 < d < 60


def test_registry():
    r = Registry()
    r.register("Blur", lambda df, k=1: (df, k), {"k": 3}, aliases=("b",))
    assert r.apply("B", "x") == ("x", 3) and r.apply("blur", "x", k=5) == ("x", 5)
    with pytest.raises(ValueError):
        r.register("b", lambda df: df)


def test_thresholds_of_every_event(spark):
    """T9 ends its stream, so that the last hour's events are not left out."""
    sf = "/root/testdata/sf0.001"
    want = [r["event_id"] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()]
    got = [r["seq"] for r in catalog.queries()["t09_stream_thresholds"](spark, sf).select("seq").collect()]
    assert sorted(got) == sorted(want)


def test_percentile_of_large_groups_is_exact(spark):
    rows = spark.range(300_000).selectExpr("timestamp '2024-01-01' as ts", "'a' as topic", "false as rejected", "cast(id * 7919 % 300007 as double) as latency")
    want = sorted(k * 7919 % 300007 for k in range(300_000))[285_000 - 1]
    assert T.throughput(rows, "1 day").first()["p95"] == want
