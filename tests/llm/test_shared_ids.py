"""Training order of rows without a doc_id or with the same one, and the number of shards."""

import pytest

from driftloom.llm import tokenbin
from driftloom.llm.queries import vocabulary


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_spread_over_shards(spark, monkeypatch, doc_id):
    monkeypatch.setattr(tokenbin, "TEXT_BYTES", 1)
    monkeypatch.setattr(tokenbin, "SHARD", 5000)
    texts = [f"{k} " + " ".join(f"word{k}and{j}" for j in range(400)) for k in range(40)]
    docs = spark.createDataFrame([(doc_id, t) for t in [*texts, texts[0]]] + [(8, None), (9, "")], "doc_id long, text string")
    rows = tokenbin.manifest(docs, vocabulary()).collect()
    assert {r["doc_id"] for r in rows} == {doc_id}
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(r["seq"] == 0 for r in rows) == 41
    load = {}
    for r in rows:
        load[r["shard"]] = load.get(r["shard"], 0) + 1
    assert max(load.values()) <= len(rows) / 4
    again = tokenbin.manifest(docs.repartition(5), vocabulary()).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_shards_grow_with_large_inputs_only():
    unit = tokenbin.TEXT_BYTES * tokenbin.SHARD
    assert [tokenbin.shards_for(n) for n in (0, unit, 100 * unit)] == [1, 1, 100]
    assert tokenbin.shards_for(unit * 30_000) == tokenbin.WRITERS
    assert tokenbin.shards_for(100 * 10**12) < 1_000_000
