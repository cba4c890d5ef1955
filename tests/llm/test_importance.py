"""Importance resampling against its SQL, plain loops and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from driftloom.llm import resample
from driftloom.llm.queries import ORACLE_SQL, queries
from tests.oracle import compare, connection

SCHEMA = "doc_id long, text string, weight string, rank int, bucket long"
BENCH = "item_id long, text string"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def features(text, most):
    w = words(text)
    return [" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1)]


def plain(docs, bench, most, buckets=resample.BUCKETS, share=10, least=20):
    """What the contract says, document by document."""
    at = lambda x: zlib.crc32(x.encode()) % buckets
    s = Counter(at(x) for _, text in docs for x in features(text, most))
    t = Counter(at(x) for text in bench for x in features(text, most))
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found = features(text, most)
        weight = math.floor(sum(gain[at(x)] for x in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * share // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_importance_is_its_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        assert compare(spark, connection(path), queries()["op11_importance"], ORACLE_SQL["op11_importance"], path) is None


@pytest.fixture(scope="module")
def odd(spark):
    long = "Word Ünï " * 40_000
    rows = [(1, "a b\nc d\n\ne" * 9), (1, "a b\nc d\n\ne" * 9), (2, None), (3, ""), (None, "x y z " * 30), (None, "x y z " * 30), (4, long), (5, " \n\r\n"), (6, "a\x00B 9\nB"), (7, "a b " * 5 + "\n" + "c d " * 5)]
    rows += [(k, "same line here\n" * 4 + f"own {k} words follow here and there") for k in range(10, 60)]
    return spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA).repartition(5), rows


@pytest.mark.parametrize("most", [1, 2, 4])
def test_importance_against_plain_loops(spark, odd, most):
    docs, rows = odd
    bench = ["own words follow\nhere", None, "", "x y"]
    got = resample.draw(docs, spark.createDataFrame(list(enumerate(bench)), BENCH), most=most).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, bench, most)


def test_runs_across_lines():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "\n", "c "]) for _ in range(rng.randrange(40)))
        for most in (1, 2, 3, 5):
            lines = resample.lines_of(text)
            got = Counter(x for line in lines for x in resample.inside(line, most)) + Counter(resample.crossing(lines, most))
            assert got == Counter(x.encode() for x in features(text, most)), (text, most)


def test_drawn_documents_keep_their_columns(spark, odd):
    docs, rows = odd
    bench = spark.createDataFrame([(1, "own words")], BENCH)
    out = resample.resampled(docs, bench, share=50)
    want = [r[0] for r in plain(rows, ["own words"], 1, share=50) if r[4]]
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter(want)


def test_importance_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], BENCH)
    assert resample.draw(none, bench).count() == 0 and resample.resampled(none, bench).columns == none.columns
    got = resample.draw(odd[0], bench).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(odd[1], [], 1)


def test_reruns_and_splits_agree(spark, odd):
    bench = spark.createDataFrame([(1, "own words")], BENCH)
    runs = [sorted(map(tuple, resample.draw(odd[0].repartition(n), bench).collect()), key=str) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_forgetting_buckets(monkeypatch):
    monkeypatch.setattr(resample, "REMEMBERED", 3)
    b = resample.Buckets(100)
    assert [b[str(k).encode()] for k in range(20)] == [zlib.crc32(str(k).encode()) % 100 for k in range(20)] and len(b) <= 3
