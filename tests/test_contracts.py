"""Gated publishing, typed source contracts, stages replaced by partition."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from catchment.sinks import tables as sinks
from catchment.sources.store_sources import Field, StoreSource, checked_union, write_checked


def _files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_a_bad_table_is_refused_and_the_target_stays(spark):
    schema = "k int, grp string, name string"
    good = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], schema)
    sinks.create_table(good, "gate_target")
    bad = {
        "no rows": good.limit(0),
        "k is NULL in 1 rows": good.unionByName(spark.createDataFrame([(None, "c", "z")], schema)),
        "1 groups of grp with several name": good.unionByName(spark.createDataFrame([(3, "a", "other")], schema)),
    }
    for message, table in bad.items():
        with pytest.raises(sinks.RefusedTable, match=message):
            sinks.publish_checked(table, "gate_target", ["k"], (["grp"], "name"))
        assert sorted(tuple(r) for r in spark.table("gate_target").collect()) == [(1, "a", "x"), (2, "b", "y")]
    wider = spark.createDataFrame([("z", 9, "extra", "c")], "name string, k int, more string, grp string")
    sinks.publish_checked(wider, "gate_target", ["k"], (["grp"], "name"))
    assert [tuple(r) for r in spark.table("gate_target").collect()] == [(9, "c", "z")]


def test_every_source_row_is_accepted_or_rejected_with_all_reasons(spark):
    contract = {"N": Field("bigint", required=True), "X": Field("double", low=-1.0, high=1.0), "T": Field("string")}
    a = spark.createDataFrame([("1", "0.5", "t"), ("one", "2", None), (None, None, None), ("4", "-1.5", "t")], "N string, X string, T string")
    b = spark.createDataFrame([(7, 1.0), (8, None)], "NUM bigint, X double")
    checked = checked_union([StoreSource(a, "A"), StoreSource(b, "B", {"NUM": "N"}, F.col("N") > 0)], contract)
    good, bad = write_checked(checked, "contract_test")
    assert good.columns == ["N", "X", "T", "SOURCE"] and dict(good.dtypes)["N"] == "bigint"
    key = lambda r: (r[3], r[0] or 0)
    assert sorted((tuple(r) for r in good.collect()), key=key) == [(1, 0.5, "t", "A"), (7, 1.0, None, "B"), (8, None, None, "B")]
    assert sorted((r["SOURCE"], r["REASONS"]) for r in bad.collect()) == [
        ("A", "N is missing"), ("A", "N is not a bigint; X is out of range"), ("A", "X is out of range"),
    ]


def test_a_required_column_that_a_source_lacks_rejects_its_rows(spark):
    source = StoreSource(spark.createDataFrame([(1,)], "N int"), "A")
    row = checked_union([source], {"N": Field("int"), "M": Field("string", required=True)}).first()
    assert (row["N"], row["M"], row["REASONS"]) == (1, None, "M is missing")


def test_replacing_a_partition_leaves_the_other_files(spark):
    rows = spark.range(30).select("id", (2020 + F.col("id") % 3).cast("int").alias("YEAR"))
    path = sinks.write_partitioned_stage(rows, "by_year", ["YEAR"])
    before = _files(path)
    # columns in another order, one year only
    sinks.replace_partitions(spark.createDataFrame([(2021, 99)], "YEAR int, id bigint"), "by_year", ["YEAR"])
    after = _files(path)
    same = {f for f in before if "YEAR=2021" not in f}
    assert same and {f for f in after if "YEAR=2021" not in f} == same and all(before[f] == after[f] for f in same)
    assert not {f for f in before if "YEAR=2021" in f} & set(after)
    read = sinks.read_stage(spark, "by_year", F.col("YEAR") == 2021)
    assert [tuple(r) for r in read.collect()] == [(99, 2021)]
    assert "PartitionFilters: [isnotnull(YEAR" in read._jdf.queryExecution().executedPlan().toString()
    # a whole overwrite drops the years that are gone
    sinks.write_partitioned_stage(rows.filter("YEAR = 2020"), "by_year", ["YEAR"])
    assert {r[0] for r in sinks.read_stage(spark, "by_year").select("YEAR").distinct().collect()} == {2020}
