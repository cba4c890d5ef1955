import pytest
from pyspark.sql import functions as F

from driftloom.operators import evidence, tiles


def test_tiles_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "def f(a.b)\n" * 30)], "k int, text string")
    got = tiles.text_tiles(docs, "k").groupBy("k").agg(F.count("*").alias("n"), F.max("edge").alias("top"), F.count_if("roi").alias("roi")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 4, 0.0, 1), (2, 4, 0.0, 1), (3, 4, 1.0, 1)]
    assert tiles.text_tiles(docs.limit(0), "k").count() == 0


def test_subtree_of_a_small_tree(spark):
    tree = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 1, 4), (4, 3, 8)], "id int, parent int, w int")
    got = {r["id"]: (r["total"], r["children"]) for r in evidence.subtree(tree, "id", "parent", "w").collect()}
    assert got == {1: (15, 2), 2: (2, 0), 3: (12, 1), 4: (8, 0)}


def test_unknown_evidence_is_invalid(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 0.1, 0.2, 0.3), ([1.5], 0.1, 0.2, 0.3), ([1.0], 0.3, 0.2, 0.3), ([1.0], None, 0.2, 0.3), (None, 0.1, 0.2, 0.3)], "v array<double>, a double, b double, z double")
    ok = evidence.evidence_valid(F.col("v"), F.col("a"), F.col("b"), F.col("z"))
    assert [r[0] for r in rows.select(ok).collect()] == [True, False, False, False, False]


def test_constant_columns_have_no_relation(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "k int, a double, b double")
    assert {r["k"]: r["rho"] for r in tiles.relation(rows, "k", "a", "b").collect()} == {1: 0.0, 2: pytest.approx(1.0)}


def test_lines_are_stripped_of_all_white_space(spark):
    word = next(iter(tiles.KEYWORDS))
    plain, tabbed = f"{word} x(1)", f"\t {word} x(1)\r "
    rows = spark.createDataFrame([(1, plain), (2, tabbed)], "doc_id long, text string")
    got = {r.doc_id: r.entropy for r in tiles.text_tiles(rows, "doc_id").filter("tile = 0").collect()}
    assert got[1] == got[2] > 0
