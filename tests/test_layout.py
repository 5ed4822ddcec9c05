from pyspark.sql import Window
from pyspark.sql import functions as F

from catchment.plans import layout


def test_broadcast_bound_is_in_bytes(spark):
    df = spark.createDataFrame([("abc", 1), (None, 2)], "s string, n long")
    assert layout.table_bytes(df) == 2 * (16 + 8 + 8) + 3
    assert layout.fits_broadcast(df, max_bytes=67) and not layout.fits_broadcast(df, max_bytes=66)
    assert layout.table_bytes(df.limit(0)) == 0


def test_keyed_totals_equals_window_with_null_keys(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), (None, 3.0), (None, 4.0), ("b", 5.0)], "k string, v double"
    )
    key = lambda t: tuple((x is None, x) for x in t)
    got = sorted((tuple(r) for r in layout.keyed_totals(df, ["k"], {"t": F.sum("v")}).collect()), key=key)
    want = sorted((tuple(r) for r in df.withColumn("t", F.sum("v").over(Window.partitionBy("k"))).collect()), key=key)
    assert got == want


def test_materialize_keeps_rows(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    m = layout.materialize(df)
    assert m.count() == 100 and m.agg(F.sum("x")).first()[0] == 9900


def test_numbers_are_dense_and_ordered(spark):
    rows = [(f"k{i % 37:02d}", i if i % 5 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b int").distinct().repartition(6)
    got = sorted((r.n, r.a, r.b) for r in layout.numbered(df, "n").collect())
    order = sorted(set(rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    assert got == [(i, *r) for i, r in enumerate(order)]
    assert layout.numbered(df.limit(0), "n").collect() == []


def test_copies_are_parquet_and_pruned(spark):
    copy = layout.materialize(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    assert "ReadSchema: struct<twice:bigint>" in copy.select("twice")._jdf.queryExecution().executedPlan().toString()
