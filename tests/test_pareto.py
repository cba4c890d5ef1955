"""Pareto fronts (W6) merged from tasks' own, against every pair."""

import random

from driftloom.operators import series


def test_fronts_by_key_and_of_all(spark):
    rng = random.Random(9)
    rows = [(rng.choice(("a", "b", None)), rng.randrange(12), rng.randrange(12), k) for k in range(300)] + [("n", None, 3, -1), ("n", 2, 1, -2)]
    df = spark.createDataFrame(rows, "k string, h long, l int, id long").repartition(6)
    full = [r for r in rows if r[1] is not None]
    for by in ("k", None):
        same = lambda a, b: by is None or a[0] == b[0]  # noqa: B023, E731
        want = {(by and r[0], r[1], r[2]) for r in full if not any(same(r, o) and o[1] >= r[1] and o[2] <= r[2] and (o[1], o[2]) != (r[1], r[2]) for o in full)}
        out = series.pareto_front(df, by, "h", "l")
        got = [(by and r["k"], r["h"], r["l"]) for r in out.collect() if r["h"] is not None]
        assert out.columns == df.columns and len(got) == len(set(got)) and set(got) == want
    assert series.pareto_front(df.filter("false"), "k", "h", "l").count() == 0


def test_of_equal_rows_the_first_by_the_other_columns(spark):
    rows = [("a", 5, 1, k) for k in (9, None, 3, 7)] + [("b", 5, 1, 4), ("b", 5, 1, 2), ("b", 6, 2, 8)]
    for parts in (1, 3):
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, "k string, h long, l long, id long").repartition(parts, "id")
            assert sorted((r["k"], r["h"], r["id"]) for r in series.pareto_front(df, "k", "h", "l").collect()) in ([("a", 5, None), ("b", 5, 2), ("b", 6, 8)],)
            full = df.filter("id IS NOT NULL")
            assert sorted((r["k"], r["h"], r["id"]) for r in series.pareto_front(full, None, "h", "l").collect()) == [("a", 5, 3), ("b", 6, 8)]
