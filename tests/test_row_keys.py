"""X3 as a table function on Arrow batches."""

from collections import Counter

from driftloom.operators.delta import RowKeys


def test_keys_of_rows_with_nulls(spark):
    rows = [("a_b", 12), ("a", -3), (None, 10), ("x_y_z", None), (None, None), ("", 2**53 + 7)] * 50
    spark.createDataFrame(rows, "kind string, bucket long").createOrReplaceTempView("rows_with_nulls")
    spark.udtf.register("some_row_keys", RowKeys)
    df = spark.sql("select key from some_row_keys(table(rows_with_nulls))")
    want = Counter()
    for kind, bucket in rows:
        if kind is not None:
            want.update([f"T:{kind}", f"KIND:{kind.split('_')[0]}"])
        if bucket is not None:
            want.update([f"U:{bucket % 10}"])
    assert Counter(r.key for r in df.collect()) == want
    assert "ArrowEvalPythonUDTF" in df._jdf.queryExecution().toString()
    assert spark.sql("select * from some_row_keys(table(select * from rows_with_nulls where false))").count() == 0
