"""Two-level running sums and the medians by rank, against plain Python."""

import random
from itertools import accumulate
from statistics import median

from pyspark.sql import functions as F

from catchment.operators import levels as lv
from catchment.plans.layout import prefix_sums


def test_running_sums_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(50), i, rng.randrange(-9, 9)) for i in range(2000)]
    rows += [(None, 1, 1, 4), (None, None, 2, 3), ("one", None, 0, None)]
    df = spark.createDataFrame(rows, "g string, a int, b int, v bigint")
    got = prefix_sums(df, ["g"], ["a", "b"], "v", "s", partitions=16)
    assert got.columns == ["g", "a", "b", "v", "s"]
    found = {(r["g"], r["b"]): r["s"] for r in got.collect()}
    assert len(found) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        sums = list(accumulate(r[3] or 0 for r in own))
        assert [found[(g, r[2])] or 0 for r in own] == sums
    assert found[("one", 0)] is None


def test_a_hot_group_is_dealt_over_pieces(spark):
    df = spark.range(4000).select(F.lit("x").alias("g"), "id")
    pieces = df.repartitionByRange(8, "g", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(pieces) == 8 and max(r["count"] for r in pieces) < 1500  # what prefix_sums relies on
    last = prefix_sums(df, ["g"], ["id"], "id", "s", 8).agg(F.max("s"), F.count("*")).first()
    assert tuple(last) == (3999 * 4000 // 2, 4000)


def test_medians_by_rank(spark):
    rng = random.Random(9)
    groups = {"hot": [rng.randrange(40) / 4 for _ in range(1500)], "even": [1.0, 2.0, 8.0, 9.0], "one": [3.5],
              "ties": [2.0] * 9 + [7.0] * 9, "part": [None, 4.0, None, 6.0], "none": [None, None], None: [1.0, 5.0]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["m"] for r in lv.exact_medians(df, ["g"], "v", "m").collect()}
    want = {g: median(known) if (known := [v for v in values if v is not None]) else None for g, values in groups.items()}
    assert got == want
