"""Stateful streams over several batches, with failures and expiry, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftloom.streaming import events as T
from driftloom.streaming import state as ST

BEGAN = dt.datetime(2024, 1, 1)


def at(second):
    return BEGAN + dt.timedelta(seconds=second)


def add(spark, path, rows, schema, number):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/n={number}")


def run(spark, path, schema, make):
    """Runs a stream over what has come since the last run; all that it has written."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    return T.run_once(make(stream), f"{path}/out")


def flow(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice("abc"), k, at(k), rng.choice((1.0, 2.0, 90.0)) if k > 150 else rng.random()) for k in range(n)]


VALUES = "k string, seq long, ts timestamp, value double"


def thresholds(rows, n=30, delta=0.1, limit=20.0, freeze=7):
    out, known = [], {}
    for key, seq, _, value in sorted(rows, key=lambda r: r[2]):
        xs, c, low, since, held = known.get(key, ([], 0.0, float("inf"), freeze + 1, None))
        xs = [*xs, value]
        c += value - sum(xs) / len(xs) - delta
        low = min(low, c)
        since = 0 if c - low > limit else since + 1
        last = sorted(xs[-n:])
        q = lambda p: last[int((len(last) - 1) * p)] + (last[min(int((len(last) - 1) * p) + 1, len(last) - 1)] - last[int((len(last) - 1) * p)]) * ((len(last) - 1) * p % 1)  # noqa: B023, E731
        held = q(0.9) if since > freeze else held
        known[key] = xs, c, low, since, held
        out.append((key, seq, q(0.9), q(0.95), q(0.99), c - low > limit, held))
    return sorted(out, key=lambda r: r[:2])


def test_thresholds_over_batches_and_a_failure(spark, tmp_path, monkeypatch):
    """Rows out of order within the lateness, several runs, one of which breaks off."""
    rows = flow(11)
    mixed = sorted(rows, key=lambda r: r[1] + random.Random(r[1]).uniform(0, 40))
    cuts = [0, 100, 104, 220, 300]
    make = lambda e: ST.threshold_stream(e, "k", 30, 0.1, 20.0, 7, "60 seconds")
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        add(spark, tmp_path, mixed[a:b], VALUES, k)
        if k == 2:
            with monkeypatch.context() as m:
                def fails(self, key, due, now):
                    raise RuntimeError("lost")

                m.setattr(ST.Thresholds, "step", fails)
                bad = lambda e: make(e).withColumn("z", F.raise_error(F.lit("lost")))
                with pytest.raises(Exception, match="lost"):
                    run(spark, tmp_path, VALUES, bad)
        got = run(spark, tmp_path, VALUES, make)
    add(spark, tmp_path, [("z", 999, at(9999), 0.0)], VALUES, 9)  # moves the watermark on
    got = sorted(map(tuple, run(spark, tmp_path, VALUES, make).collect()))
    want = thresholds(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(x == pytest.approx(y, abs=1e-9) for a, b in zip(got, want, strict=True) for x, y in zip(a[2:], b[2:], strict=True))
    assert any(r[5] for r in want)


def test_ewma_of_one_batch_and_of_several(spark, tmp_path):
    rows, make = flow(3, 90), lambda e: ST.ewma_stream(e, "k", 0.3, "0 seconds")
    for k in range(3):
        add(spark, tmp_path / "many", rows[30 * k : 30 * k + 30], VALUES, k)
    add(spark, tmp_path / "one", rows, VALUES, 0)
    several = sorted(map(tuple, run(spark, tmp_path / "many", VALUES, make).collect()))
    once = sorted(map(tuple, run(spark, tmp_path / "one", VALUES, make).collect()))
    mean, want = {}, []
    for key, seq, _, value in rows:
        mean[key] = value if key not in mean else 0.3 * value + 0.7 * mean[key]
        want.append((key, seq, pytest.approx(mean[key])))
    assert several == once == sorted(want, key=lambda r: r[:2])


def test_open_starts_expire_and_leave_no_state(spark, tmp_path):
    schema = "key string, kind string, ts timestamp"
    second = 1_000_000
    parts = [
        [("u", "start", at(1)), ("v", "start", at(2)), ("w", "start", at(2)), ("u", "other", at(3))],
        [("u", "done", at(5)), ("v", "error", at(5)), ("v", "done", at(6)), ("x", "start", at(50)), ("y", "start", at(50))],
        [("w", "done", at(51)), ("x", "done", at(52)), ("x", "done", at(53))],
        [("z", "error", at(200))],
    ]
    for k, rows in enumerate(parts):
        add(spark, tmp_path, rows, schema, k)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = ST.clean_runs(stream, "key", "start", "done", "error", 10 * second, "0 seconds")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    micros = int(BEGAN.replace(tzinfo=dt.UTC).timestamp() * second)
    assert sorted((r["key"], (r["started"] - micros) // second, (r["ended"] - micros) // second) for r in got) == [("u", 1, 5), ("x", 50, 52)]
    # two runs are never done (w in time, y at all): their state has gone with their timers
    rows = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators]
    assert max(rows) > 0 and rows[-1] == 0


def test_late_rows_of_many_batches_are_counted(spark, tmp_path):
    """More batches than a query remembers the progress of."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 3)
    schema = "event_id long, ts timestamp"
    add(spark, tmp_path, [(0, at(10_000))], schema, 0)
    T.run_counted(T.deduplicated(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), ["event_id"], "1 second"), f"{tmp_path}/out")
    for k in range(1, 13):
        spark.createDataFrame([(k, at(k))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n=1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    row = T.run_counted(T.deduplicated(stream, ["event_id"], "1 second"), f"{tmp_path}/out").first()
    assert (row["kept"], row["late"]) == (1, 12)
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
