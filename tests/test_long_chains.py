import pytest
from pyspark.sql import functions as F

from driftloom.operators import cycles, events, evidence, graph


def chain(spark, n):
    return spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight")).coalesce(1)


def test_search_goes_past_fifty_steps(spark):
    src = spark.createDataFrame([(0, 0)], "source long, id long")
    got = {r["id"]: r["dist"] for r in graph.bfs(src, chain(spark, 54)).collect()}
    assert got == {k: k for k in range(55)}
    assert {r["id"] for r in graph.bfs(src, chain(spark, 54), 3).collect()} == set(range(4))


def test_subtree_of_a_long_chain(spark):
    tree = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), (F.col("id") + 1).alias("w"))
    got = {r["id"]: (r["total"], r["children"]) for r in evidence.subtree(tree, "id", "parent", "w").collect()}
    assert got == {k: (sum(range(k + 1, 301)), int(k < 299)) for k in range(300)}
    with pytest.raises(ValueError):
        evidence.subtree(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, parent long, w long"), "id", "parent", "w")


def test_a_long_chain_has_no_cycle(spark):
    assert cycles.components(chain(spark, 204)).count() == 0


def test_causal_chains_end_and_cycles_are_errors(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = {r["id"]: (r["root"], r["depth"]) for r in events.causal_chain(rows, "id", "parent").collect()}
    assert got == {k: (0, k) for k in range(1000)}
    with pytest.raises(ValueError):
        events.causal_chain(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "id long, parent long"), "id", "parent")
