"""Pair join, attraction, totals, running shares and cuts on small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from catchment import schemas
from catchment.operators import adjacency as adjm
from catchment.operators import attraction as att
from catchment.sources import tables

STORE_RAW_COLS = [f.name for f in schemas.STORES_RAW.fields]


def stores_df(spark, rows):
    """rows: (num, name, banner, province, lon, lat, revenue, chain)."""
    full = [
        (n, name, banner, f"{n} ST", None, prov, chain, lon, lat, rev, "GROCERY", "EAST TEAM")
        for (n, name, banner, prov, lon, lat, rev, chain) in rows
    ]
    return tables.load_stores(spark.createDataFrame(full, schemas.STORES_RAW))


def ldu_df(spark, rows):
    """rows: (postal, prov, lon, lat, area)."""
    return spark.createDataFrame(rows, schemas.LDU_POLYGONS)


def test_adjacency_has_46_pairs_and_one_way_pair(spark):
    pairs = {(r.STORE_PROV, r.LDU_PROV) for r in adjm.adjacency(spark).collect()}
    assert len(pairs) == 46
    assert ("NL", "PE") in pairs and ("PE", "NL") not in pairs
    one_way = {(a, b) for (a, b) in pairs if (b, a) not in pairs}
    assert one_way == {("NL", "PE")}


def test_unknown_province_reaches_nothing(spark):
    s = stores_df(spark, [(1, "A #1", "B1", "XX", -75.0, 45.0, 10.0, "G"), (2, "A #2", "B1", None, -75.0, 45.0, 10.0, "G")])
    l = tables.largest_polygon(ldu_df(spark, [("P1", "ON", -75.1, 45.1, 1.0)]))
    assert adjm.pairs(s, l).count() == 0


def test_salted_fallback_equals_broadcast(spark, sf_small):
    from catchment.plans import inputs

    s, l = inputs.stores(spark, sf_small), inputs.ldu(spark, sf_small)
    cols = ["STORE_NUM", "POSTALCODE", "PROV"]
    fast = sorted(tuple(r) for r in adjm.pairs(s, att.layout_postal(l)).select(*cols).collect())
    spark.conf.set("catchment.broadcast.maxBytes", "0")
    try:
        salted = sorted(tuple(r) for r in adjm.pairs(s, att.layout_postal(l)).select(*cols).collect())
    finally:
        spark.conf.unset("catchment.broadcast.maxBytes")
    assert fast == salted and len(fast) > 0


@pytest.mark.parametrize("bound", [None, "0"])
def test_pairs_by_store_are_the_pairs(spark, sf_mid, bound):
    """The same rows with and without a broadcast, runs of them of one store, and no pair shuffled."""
    from catchment.plans import inputs

    s, l = inputs.stores(spark, sf_mid), inputs.ldu(spark, sf_mid)
    odd = spark.createDataFrame([("TWICE", "ON", -75.0, 45.0)] * 2 + [("NONE", None, -75.0, 45.0), (None, "QC", None, None)],
                                "POSTALCODE string, PROV string, LONGITUDE double, LATITUDE double")
    l, cols = l.unionByName(odd), [*l.columns, *s.columns]
    want = adjm.pairs(s, att.layout_postal(l, 1)).select(*cols)
    if bound:
        spark.conf.set("catchment.broadcast.maxBytes", bound)
    try:
        got = adjm.pairs_by_store(s, l, 1)
    finally:
        spark.conf.unset("catchment.broadcast.maxBytes")
    assert got.columns == cols
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "Generate explode(__codes" in top and "Exchange" not in top
    after = [r.STORE_NUM for r in got.collect()]
    changes = sum(x != y for x, y in zip(after, after[1:]))
    assert len(after) > 10_000 and changes < len(after) / 4, (changes, len(after))


def test_largest_polygon_with_ties_is_deterministic(spark):
    polys = ldu_df(
        spark,
        [
            ("P1", "ON", -75.0, 45.0, 5.0),
            ("P1", "ON", -76.0, 46.0, 9.0),
            ("P1", "ON", -77.0, 47.0, 9.0),  # same area: smaller longitude wins
            ("P1", "ON", -70.0, 40.0, None),  # no area never wins
            ("P2", "QC", -71.0, 46.0, None),  # only polygon without area
        ],
    )
    got = {r.POSTALCODE: (r.LONGITUDE, r.LATITUDE) for r in tables.largest_polygon(polys).collect()}
    assert got == {"P1": (-77.0, 47.0), "P2": (-71.0, 46.0)}


def _att(spark):
    s = stores_df(
        spark,
        [
            (1, "A #1", "B1", "ON", -75.00, 45.00, 100.0, "G"),
            (2, "A #2", "B2", "ON", -75.10, 45.05, 50.0, "G"),
            (3, "A #3", "B1", "QC", -74.90, 45.10, 80.0, "G"),
            (4, "A #4", "B3", "ON", -75.20, 45.20, 0.0, "G"),
        ],
    )
    l = tables.largest_polygon(
        ldu_df(
            spark,
            [
                ("P1", "ON", -75.00, 45.00, 1.0),  # at store 1: distance 0
                ("P2", "ON", -75.05, 45.02, 1.0),
                ("P3", "QC", -74.95, 45.08, 1.0),
                ("P4", "MB", -97.00, 49.90, 1.0),
            ],
        )
    )
    return att.full_attraction(s, l)


def test_zero_distance_gives_null_attraction_and_is_cut(spark):
    full = _att(spark)
    z = full.filter((F.col("STORE_NUM") == 1) & (F.col("POSTALCODE") == "P1")).first()
    assert z.HAVERSINE_DISTANCE == 0.0 and z.Attraction is None
    half = att.shares(full, att.HALF_PERCENT)
    assert half.filter((F.col("STORE_NUM") == 1) & (F.col("POSTALCODE") == "P1")).count() == 0


def test_shares_sum_to_one_per_postal_code(spark):
    half = att.shares(_att(spark), att.HALF_PERCENT)
    sums = half.groupBy("POSTALCODE").agg(F.sum("PERCENT_ATTRACTION").alias("s")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-12 for r in sums)
    # zero revenue never passes the strict cut
    assert half.filter(F.col("STORE_NUM") == 4).count() == 0


def test_last_running_share_is_one(spark, sf_small):
    from catchment.plans import inputs

    full = inputs.full_attraction(spark, sf_small)
    last = full.groupBy("POSTALCODE").agg(F.max("CUMULATIVE_PERCENT_ATTRACTION").alias("m")).collect()
    assert last and all(abs(r.m - 1.0) < 1e-9 for r in last if r.m is not None)


def test_excluding_max_with_one_store_gives_zero_total(spark):
    s = stores_df(spark, [(1, "A #1", "B1", "ON", -75.0, 45.0, 100.0, "G")])
    l = tables.largest_polygon(ldu_df(spark, [("P1", "ON", -75.1, 45.1, 1.0)]))
    t = att.postal_total(att.attraction(s, l), exclude_max=True).first()
    assert t.TOTAL_POSTALCODE_ATTRACTION == 0.0


def test_cut_is_strict_and_share_bound(spark, sf_small):
    from catchment.plans import inputs

    half = inputs.half_pct(spark, sf_small)
    per_pc = half.groupBy("POSTALCODE").count().agg(F.max("count")).first()[0]
    assert per_pc < 200  # every kept store holds more than 0.5% of its postal code
    assert half.filter(F.col("Attraction") <= 0.005 * F.col("TOTAL_POSTALCODE_ATTRACTION")).count() == 0


def test_salted_fallback_shares_equal_broadcast_shares(spark, sf_small):
    from catchment.plans import inputs

    cols = ["STORE_NUM", "POSTALCODE", "PERCENT_ATTRACTION", "CUMULATIVE_PERCENT_ATTRACTION"]

    def rows():
        return sorted(
            (r[0], r[1], round(r[2], 12), round(r[3], 12) if r[3] is not None else None)
            for r in inputs.half_pct(spark, sf_small).select(*cols).collect()
        )

    fast = rows()
    spark.conf.set("catchment.broadcast.maxBytes", "0")
    try:
        salted = rows()
    finally:
        spark.conf.unset("catchment.broadcast.maxBytes")
    assert fast == salted and len(fast) > 0


def test_partitions_follow_the_pairs(spark, sf_small, monkeypatch):
    from catchment.plans import inputs

    s, l = inputs.stores(spark, sf_small), inputs.ldu(spark, sf_small)
    n, pairs = int(spark.conf.get("spark.sql.shuffle.partitions")), adjm.pairs(s, l).count()
    assert att.pair_partitions(s, l) == n
    monkeypatch.setattr(att, "PAIRS_A_TASK", 1 + pairs // (3 * n))
    assert att.pair_partitions(s, l) == 3 * n
    assert att.postal_total(att.attraction(s, l)).rdd.getNumPartitions() == 3 * n


def test_province_pairs_reads_one_row_of_a_province(spark, sf_small):
    import __spark_entry__ as E
    from catchment.plans import inputs

    got = E.queries()["province_pairs"](spark, sf_small)
    want = adjm.province_pairs(adjm.pairs(inputs.stores(spark, sf_small), inputs.ldu(spark, sf_small)))
    assert got.collect() == want.collect()
    assert re.search(r"Aggregate \[STORE_PROVINCE#\d+\]", got._jdf.queryExecution().optimizedPlan().toString())


def test_significant_digits_equal_the_rounded_text(spark):
    from catchment.present import significant

    df = spark.sql("SELECT explode(array(0D, 1D, -10D, 999999999.5D, 1e-9D, 123456789.4D, 0.1D, 1e22D, 1e31D, 1e-20D, "
                   "-2.718281828459D, double('NaN'), double('Infinity'), NULL)) AS x")
    text = F.when(F.col("x").isNotNull(), F.format_string("%.8e", "x").cast("double"))
    rows = df.select(significant(F.col("x"), 9).alias("a"), text.alias("b"), "x").collect()
    assert len(rows) == 14
    assert all((r.a is None) if r.x is None else repr(r.a) == repr(r.b) for r in rows)


def test_postal_windows_do_not_sort_the_pairs(spark, sf_small):
    import __spark_entry__ as E

    for name in ("attraction_total", "attraction_max"):
        plan = E.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("BroadcastHashJoin")]
        assert "Window" in above and "Sort" not in above and "Exchange" not in above


def _odd_pairs(spark):
    """Stores that repeat or share a place, and codes at a store, without a place, without a code or in two provinces."""
    s = [(i, f"S #{i % 7}", f"B{i % 3}", ("ON", "QC", "MB")[i % 3], -75.0 - (i % 11) / 10, 45.0 + (i % 4) / 10, 10.0 * (i % 5), "G") for i in range(120)]
    s += [s[3], s[3], s[4], (200, None, None, "ON", -75.0, None, 7.0, "G"), (201, "N", "B", "ON", None, 45.0, 7.0, "G"),
          (None, "N", "B", "QC", -75.05, 45.0, 8.0, "G"), (None, "N", "B", "QC", -75.05, 45.0, 8.0, "G")]
    codes = [("P1", "ON", -75.3, 45.2), ("P1", "QC", -75.3, 45.2), ("P2", "QC", -74.0, 46.0), ("P3", "MB", -97.0, 49.9),
             ("P4", "ON", None, 45.0), (None, "QC", -74.0, 46.0), ("P5", None, -74.0, 46.0)]
    return stores_df(spark, s), spark.createDataFrame(codes, "POSTALCODE string, PROV string, LONGITUDE double, LATITUDE double")


def _wide(spark, stores, codes):
    """The full table from pairs that carry every column of their store."""
    return att.running_share(att.postal_total(att.attraction(stores, codes))).select(*schemas.ATTRACTION_COLUMNS)


def _rows9(df):
    return sorted(repr([float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("bound", [None, "0"])
@pytest.mark.parametrize("piece", [5, 40, 1_000_000])
def test_split_running_share_by_pieces_is_the_window(spark, piece, bound):
    stores, codes = _odd_pairs(spark)
    want = _rows9(_wide(spark, stores, codes))
    if bound:
        spark.conf.set("catchment.broadcast.maxBytes", bound)
    try:
        keyed = att.keyed_stores(stores)
        assert (keyed.attributes is None) == bool(bound)
        got = keyed.attach(att.running_share_split(keyed, codes, piece=piece)).select(*schemas.ATTRACTION_COLUMNS)
        assert _rows9(got) == want and len(want) > 400
    finally:
        spark.conf.unset("catchment.broadcast.maxBytes")


@pytest.mark.parametrize("bound", [None, "0"])
def test_numbered_stores_give_the_full_table(spark, bound):
    stores, codes = _odd_pairs(spark)
    wide = _wide(spark, stores, codes)
    if bound:
        spark.conf.set("catchment.broadcast.maxBytes", bound)
    try:
        assert _rows9(att.full_attraction(stores, codes)) == _rows9(wide)
        keyed = att.keyed_stores(stores)
        trimmed = keyed.attach(att.trim_tail(att.running_attraction(keyed, codes))).select(*schemas.SHARE_COLUMNS)
        assert _rows9(trimmed) == _rows9(att.trim_tail(wide))
    finally:
        spark.conf.unset("catchment.broadcast.maxBytes")


def test_no_pair_is_shuffled_for_the_split_running_share(spark, sf_small):
    import __spark_entry__ as E

    plan = E.queries()["attraction_cumulative_split"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    above = plan[: plan.index("ASIN(")]
    assert "Window" in above and "Exchange" not in above.replace("BroadcastExchange", "")


@pytest.mark.parametrize("name", ["attraction_excl_max", "attraction_tail_trim", "attraction_cumulative", "attraction_cumulative_split"])
def test_sorted_pairs_carry_no_store_text(spark, sf_small, name):
    import __spark_entry__ as E

    plan = E.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if re.search(r"\bSort \[", line)]
    assert sorts and not [x for x in sorts if "STORE_NAME" in x]


def test_decimals_equal_spark_round(spark):
    from catchment.present import decimals

    odd = spark.sql("SELECT explode(array(0D, -0D, 1D, -0.00001D, 0.00005D, -0.00005D, 2.5D, 1e22D, 1e300D, -1e15D, "
                    "123456789012.34565D, 4.9e-324D, double('NaN'), double('Infinity'), double('-Infinity'), NULL)) AS x")
    many = spark.range(0, 200_000, 1, 8).selectExpr("(floor(rand(7) * 1e9) * 10 + 5) / 1e7 AS x").unionAll(
        spark.range(0, 200_000, 1, 8).selectExpr("(rand(8) - 0.5) * exp((rand(9) - 0.3) * 40) AS x")).unionAll(odd)
    for n in (4, 6):
        both = many.select("x", decimals(F.col("x"), n).alias("a"), F.round("x", n).alias("b"))
        assert both.filter("NOT (a <=> b) OR cast(a AS string) <> cast(b AS string)").collect() == []
        plan = both.select("a")._jdf.queryExecution().executedPlan().toString()
        assert "CASE WHEN" in plan  # most values take the quick branch
    kinds = dict(spark.sql("SELECT cast(1 AS decimal(9, 5)) AS val, 1 AS AREA, 1D AS value").transform(_present).dtypes)
    assert kinds == {"val": "decimal(9,4)", "AREA": "int", "value": "double"}


def _present(df):
    from catchment.present import present

    return present(df)


@pytest.mark.parametrize("bound", [None, "0"])
def test_a_list_meets_bounded_buckets_of_stores(spark, sf_small, monkeypatch, bound):
    """What one row is joined and spread into is bounded, and the pairs are the same."""
    from catchment.plans import inputs

    stores, codes = inputs.stores(spark, sf_small), inputs.ldu(spark, sf_small).repartition(1)
    many = stores.crossJoin(spark.range(40)).withColumn("STORE_NUM", F.col("STORE_NUM") * 100 + F.col("id")).drop("id")
    cols = ["STORE_NUM", "POSTALCODE", "PROV"]
    want = sorted(map(tuple, adjm.pairs(many, codes).select(*cols).collect()))
    monkeypatch.setattr(adjm, "PAIRS_A_MEETING", 8)
    if bound:
        spark.conf.set("catchment.broadcast.maxBytes", bound)
    try:
        made = adjm.pairs_by_store(many, codes, 1)
    finally:
        spark.conf.unset("catchment.broadcast.maxBytes")
    assert sorted(map(tuple, made.select(*cols).collect())) == want and len(want) > 1000
    reach = adjm.stores_with_reach(many)
    k = adjm.store_buckets(reach, codes, adjm.LISTS_A_TASK)
    assert k > 10
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Aggregate\(keys?=\[PROV#\d+, __list#\d+L, __lb#\d+L\]", plan)
