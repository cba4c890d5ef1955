"""Texts of very many matches, and the array helpers of the PII operator."""

import random
import time

from pyspark.sql import functions as F

from driftloom.llm import pii


def test_running_and_cut(spark):
    rng = random.Random(3)
    rows = [([rng.randint(-5, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 7, 8, 9, 64, 1000)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", pii._running(F.col("v"), lambda x, y: x + y).alias("s"), pii._running(F.col("v"), F.greatest).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.v[: k + 1]) for k in range(len(r.v))] and r.m == [max(r.v[: k + 1]) for k in range(len(r.v))]
    text = "aäß𝒳z" * 50
    cuts = [sorted(rng.sample(range(len(text) + 1), n)) for n in (0, 1, 2, 5, 16, 17, 200)]
    for r in spark.createDataFrame([(text, c) for c in cuts], "t string, c array<int>").select("c", pii._cut(F.col("t"), F.col("c")).alias("p")).collect():
        ends = [0, *r.c, len(text)]
        assert r.p == [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def spans(rng, n):
    starts = [rng.randint(0, 60) for _ in range(n)]
    return [("k", a, a + rng.randint(1, 6), "v", "", "") for a in starts]


def test_outside_and_redacted(spark):
    rng = random.Random(4)
    rows = [(k, spans(rng, rng.randint(0, 6)), spans(rng, rng.randint(0, 9)), "x%dy" % k * 30) for k in range(200)]
    df = spark.createDataFrame(rows, f"i int, base {pii.NO_SPANS}, others {pii.NO_SPANS}, text string")
    for r in df.withColumn("free", pii._outside(F.col("others"), F.col("base"))).collect():
        want = [o for o in r.others if not any(b.start < o.end and o.start < b.end for b in r.base)]
        assert sorted(r.free) == sorted(want)
    some = df.withColumn("spans", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    for r in pii._redacted(some).collect():
        out, at = [], 0
        for a, b in sorted((s.start, -s.end) for s in r.spans):
            if a >= at:
                out.append(r.text[at:a] + "[K]")
            at = max(at, -b)
        assert r._clean == "".join(out) + r.text[at:]


def test_a_hundred_thousand_matches(spark):
    n = 50_000
    text = " ".join(f"user{k}@host{k % 7}.org" if k % 2 else f"call {k} 0{k:07d}9" for k in range(2 * n))
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    began = time.time()
    row = pii.find(df).first()
    cleaned = pii.redact(df).first()["text"]
    assert time.time() - began < 90
    assert row.n_email == n and cleaned.count("[EMAIL]") == n and "@" not in cleaned
