"""Decontamination against its SQL, plain loops and odd rows."""

import hashlib
import random
import re

import pytest

from driftloom.llm import decontam
from driftloom.llm.queries import ORACLE_SQL, queries
from tests.oracle import compare, connection

SCHEMA = "doc_id long, text string, key string, start int, size string, words string"
BENCH = "item_id long, text string, words string"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def plain(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, said in items:
            x = words(said)
            n = min(size, len(x))
            runs = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in runs:
                    hit.update(range(k, k + n))
                    ids.add("null" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def scanned(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "k", 1, "s", "w") for r in docs], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in decontam.scan(d, spark.createDataFrame([(*r, "w") for r in items], BENCH), **more).collect()), key=str)


def test_decontamination_is_its_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        assert compare(spark, connection(path), queries()["op13_decontamination"], ORACLE_SQL["op13_decontamination"], path) is None


def test_planted_windows_are_hit(spark):
    rng = random.Random(1)
    text = lambda n, k=4000: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    items = [(k, text(rng.choice([9, 10, 11, 30, 200]))) for k in range(40)]
    docs = []
    for k in range(120):
        w, x = text(rng.randrange(400)).split(), rng.choice(items)[1].split()
        n = rng.randrange(1, 14)
        at = rng.randrange(max(1, len(x) - n + 1))
        w[rng.randrange(len(w) + 1) :][:0] = x[at : at + n]
        place = rng.randrange(len(w) + 1)
        docs.append((k, " ".join(w[:place] + [y.upper() for y in x[at : at + n]] + w[place:])))
    want = plain(docs, items)
    assert scanned(spark, docs, items) == want and 20 < sum(r[-1] for r in want) < 100


def test_few_words_repeat(spark, monkeypatch):
    """Ties of fingerprints, overlapping windows and items of every short length."""
    rng = random.Random(2)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice("abA") for _ in range(n))
    items = [(rng.randrange(12), text(rng.randrange(25))) for _ in range(25)]
    docs = [(k, text(rng.randrange(60))) for k in range(60)] + [(99, "a " * 300)]
    assert scanned(spark, docs, items) == plain(docs, items)
    monkeypatch.setattr(decontam, "BLOCK", 7)  # many blocks
    for window, gram in ((4, 2), (3, 3), (6, 1)):
        assert scanned(spark, docs, items, window=window, gram=gram) == plain(docs, items, window)


@pytest.fixture(scope="module")
def odd():
    item = "One two\tthree four: five six seven EIGHT nine ten eleven zwölf"
    docs = [(1, item), (1, item), (None, item + " x"), (2, None), (3, ""), (4, " \x00.\n"), (5, "y " * 60_000 + item + " z" * 60_000), (6, item.replace("six", "sechs")), (7, item.replace(" ", "\x00")), (8, "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN"), (9, "ist ZWÖLF zwölf")]
    return docs, [(None, item), (10, item), (9, item + " end"), (9, "short one"), (11, ""), (12, None)]


def test_decontamination_of_odd_rows(spark, odd):
    docs, items = odd
    assert scanned(spark, docs, items) == plain(docs, items)


def test_decontamination_of_empty_tables(spark, odd):
    assert scanned(spark, [], odd[1]) == []
    assert scanned(spark, odd[0], []) == plain(odd[0], [])


def test_spans_and_clean_documents(spark, odd):
    docs, items = odd
    d = spark.createDataFrame([(*r, "k", 1, "s", "w") for r in docs], SCHEMA)
    bench = spark.createDataFrame([(*r, "w") for r in items], BENCH)
    left = decontam.clean(d, bench)
    hit = {(r[0], r[1]) for r in plain(docs, items) if r[-1]}
    assert left.columns == d.columns and sorted(left.select("doc_id", "text").collect(), key=str) == sorted((r for r in docs if (r[0], len(words(r[1]))) not in hit), key=str)
    got = {tuple(r) for r in decontam.spans(d, bench).collect()}
    assert (1, 0, 12) in got and (5, 60_000, 60_012) in got and (None, 0, 12) in got


def test_no_python_in_the_plan(spark):
    plan = queries()["op13_decontamination"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
