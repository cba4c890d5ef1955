"""J27 against a loop over keys and globs."""

import fnmatch
import random

from driftloom.operators import events as E


def test_hits_are_those_of_a_loop(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc_%.") for _ in range(n))
    keys = [*{word(rng.randint(0, 9)) for _ in range(300)}, "a[b", "a]c", "x\ny", "A"]
    globs = ["*", "?", "", "a*", "*c", "*abc*", "a?c*", "[ab]*", "[!a]*b", "a[b", "*]c", "x*y", "*.*", "a_b*", "%*", "a*b*c", "*[c]", *[word(rng.randint(1, 4)) + rng.choice(["*", "?", "*a", ""]) for _ in range(60)]]
    rules = spark.createDataFrame([("s", k, g, k % 5) for k, g in enumerate(globs)], "slot string, idx int, pattern string, weight int")
    hits = E.pattern_hits(spark.createDataFrame([(k,) for k in [*keys, None]], "key string"), rules)
    got = sorted((r.key, r.idx) for r in hits.collect())
    assert got == sorted((k, i) for k in keys for i, g in enumerate(globs) if fnmatch.fnmatchcase(k, g))
    assert "NestedLoop" not in hits._jdf.queryExecution().toString()


def test_best_key_with_denied_globs(spark):
    keys = spark.createDataFrame([("ui.a",), ("ui.b",), ("raw.a",), (None,)], "key string")
    rules = spark.createDataFrame([("s", 0, "ui.*", 0), ("s", 0, "ui.b", 7), ("t", 1, "*.a", 0), ("u", 0, None, 0)], "slot string, idx int, pattern string, weight int")
    got = {r.slot: (r.key, r.score) for r in E.pattern_join(keys, rules, {}, ["raw*"], []).collect()}
    assert got == {"s": ("ui.b", 1127), "t": ("ui.a", 999)}
    assert E.pattern_join(keys.limit(0), rules, {"ui.a": 0}, [], ["ui.a"]).collect() == []
