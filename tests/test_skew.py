"""Hot keys and groups of copies: results stay whole and no group of copies
reaches a single task before it is collapsed."""

import re

from pyspark.sql import functions as F

from catchment.operators import features as feat
from catchment.operators import levels as lv

RAW_SCHEMA = "CODE string, variable string, value double, Description string, Category string"


def _tagged(spark, rows):
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    return df.select(
        "*", F.lit(1).alias("ADD_TO_PROFILE"), F.lit(1).alias("LEAF_NODE_FLAG"), F.lit(0).alias("TOTAL_FLAG"),
        F.lit("h").alias("Hierarchy_Description"), F.lit("N").alias("MEDIAN_AVERAGE"),
        F.lit(None).cast("int").alias("WHOLE_YEAR"), F.lit(2026).alias("YEAR"),
    )


BASE = [
    ("P1", "P3YBASPOP", 10.0, "Pop", "Basics"),
    ("P1", "P3YINC0", 3.0, "Inc", "Income"),
    ("P2", "P3YBASPOP", 20.0, "Pop", "Basics"),
]


def test_copies_of_one_code_give_the_same_melt(spark):
    leg = feat.demographic_legs()[1]
    heavy = _tagged(spark, BASE + [BASE[0]] * 5000)
    got = sorted((r.POSTALCODE, r.variable, r.val) for r in feat.melt_demographics(heavy, [leg]).collect())
    want = sorted((r.POSTALCODE, r.variable, r.val) for r in feat.melt_demographics(_tagged(spark, BASE), [leg]).collect())
    assert got == want


def test_cells_are_partially_aggregated_before_any_exchange(spark):
    leg = feat.demographic_legs()[1]
    plan = feat.melt_demographics(_tagged(spark, BASE), [leg])._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    cell_exchange = [i for i, l in enumerate(lines) if re.search(r"Exchange hashpartitioning\(CODE#\d+, __leg#\d+, variable", l)]
    assert cell_exchange, plan
    below = "\n".join(lines[cell_exchange[0] + 1:])
    assert "partial_max" in below  # copies collapse map-side, before the rows move
    assert "REPARTITION_BY_NUM" in plan  # then the distinct cells are laid out by code


def test_hot_store_name_percents_are_whole(spark):
    # 300 stores share one name: the percent denominator key is hot
    rows = [("S", i, "B1", "Cat", 2026, v, 1, 10.0 + k) for i in range(300) for k, v in enumerate(("v1", "v2"))]
    df = spark.createDataFrame(
        rows,
        "STORE_NAME string, STORE_NUM long, BANNER string, Category string, YEAR int, variable string, "
        "LEAF_NODE_FLAG int, BANNER_VALUE double",
    )
    name, value, keys = lv.LEVEL_PERCENTS[0]
    out = lv.level_percents(df, [(name, value, keys)]).collect()
    assert len(out) == 600
    den = sum(r.BANNER_VALUE for r in df.collect())
    assert all(abs(r[name] - r.BANNER_VALUE / den) < 1e-12 for r in out)
