import math
import random
import re

import pytest
from pyspark.sql import functions as F

from catchment import schemas
from catchment.functions.geo import haversine_km
from catchment.operators import adjacency as adj
from catchment.operators import attraction as att
from catchment.operators import spatial as sp
from catchment.plans import inputs
from catchment.present import present

STORE = "STORE_NUM STORE_NAME BANNER STORE_STREET POSTAL_CODE STORE_PROVINCE CUSTOMER_GROUP CHANNEL SALES_GROUP".split()


def made(spark, seed, negative=False):
    rng = random.Random(seed)
    provinces = ["ON", "QC", "NB", "MB", "NU", "??", None]
    stores = []
    for i in range(90):
        mass = rng.choice([1.0, 50.0, 9000.0, 0.0, *([-40.0] if negative else []), None if i % 17 == 0 else 3.0])
        lat = None if i == 5 else rng.choice([rng.uniform(-89, 89), rng.uniform(44, 46)])
        stores.append((*(f"{c}{i % 40}" for c in STORE[:5]), rng.choice(provinces), *(f"{c}{i % 4}" for c in STORE[6:]),
                       lat, rng.choice([rng.uniform(-180, 180), rng.uniform(-80, -78), 179.9, -179.9]), mass))
    codes = [(f"P{i:03d}", rng.choice(provinces), rng.uniform(43, 47), rng.choice([rng.uniform(-81, -77), 179.95, -179.95]))
             for i in range(120)]
    codes += [("SAME", "ON", s[9], s[10]) for s in stores if s[5] == "ON" and s[9] is not None][:1] + [("NULL", "ON", None, 1.0)]
    text = ", ".join(f"{c} string" for c in STORE)
    schema = f"{text}, STORE_LATITUDE double, STORE_LONGITUDE double, REVENUE_CY double"
    return (spark.createDataFrame(stores + stores[:2], schema),
            spark.createDataFrame(codes, "POSTALCODE string, PROV string, LATITUDE double, LONGITUDE double"))


def same(a, b):
    a, b = (present(x, schemas.SHARE_COLUMNS).collect() for x in (a, b))
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and a
    return len(a)


@pytest.mark.parametrize(("degrees", "cut", "negative"), [(0.7, 0.005, False), (30.0, 0.05, False), (2.0, 0.01, True)])
def test_shares_equal_the_full_plan(spark, degrees, cut, negative):
    stores, codes = made(spark, 3, negative)
    same(sp.pruned_shares(stores, codes, cut, degrees=degrees), att.shares(att.full_attraction(stores, codes), cut))


def test_shares_equal_beyond_the_broadcast_bound(spark):
    stores, codes = made(spark, 4)
    want = att.shares(att.full_attraction(stores, codes), 0.01)
    spark.conf.set("catchment.broadcast.maxBytes", "10")
    try:
        assert sp.pruned_pairs(stores, codes, 0.01) is None
        same(sp.pruned_shares(stores, codes, 0.01), want)
    finally:
        spark.conf.unset("catchment.broadcast.maxBytes")


def test_bound_is_below_every_distance(spark):
    rng, rows = random.Random(8), []
    for k in range(400):
        width, height = rng.choice([0, 1, 40, 300]), rng.choice([0, 1, 30])
        lat0, lon0 = rng.uniform(-90, 90 - height), rng.uniform(-180, 180 - width)
        lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        if k % 5 == 0:
            lat, lon = lat0, lon0
        for _ in range(8):
            rows.append((lat, lon, lat0, lat0 + height, lon0, lon0 + width,
                         lat0 + height * rng.random(), lon0 + width * rng.random()))
    names = "lat lon __lat0 __lat1 __lon0 __lon1 y x".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = df.select(sp.nearest_km("lat", "lon").alias("low"), haversine_km("y", "x", "lat", "lon").alias("d")).collect()
    assert all(r.low <= r.d + 1e-9 and not math.isnan(r.low) for r in got)
    assert sum(r.low > 0 for r in got) > 1000


def test_few_pairs_are_made(spark, sf_mid):
    stores, codes = inputs.stores(spark, sf_mid), inputs.ldu(spark, sf_mid)
    made_pairs = sp.pruned_pairs(stores, codes, att.HALF_PERCENT)
    every = adj.pairs(stores, codes).count()
    kept = same(sp.pruned_shares(stores, codes, att.HALF_PERCENT), att.shares(att.full_attraction(stores, codes)))
    assert kept <= made_pairs.count() < 0.8 * every
    assert made_pairs.filter(F.col("Attraction").isNull()).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_block_totals_equal_sums_over_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(sp, "CODE_BLOCK", 7)
    monkeypatch.setattr(sp, "STORE_BLOCK", 5)
    stores, codes = made(spark, 5)
    close = codes.limit(1).selectExpr("'NEAR' AS POSTALCODE", "'ON' AS PROV", "45.0 AS LATITUDE", "-79.0 AS LONGITUDE")
    codes = codes.unionByName(close.selectExpr("POSTALCODE", "PROV", "double(LATITUDE) LATITUDE", "double(LONGITUDE) LONGITUDE"))
    one = stores.filter("STORE_PROVINCE = 'ON'").limit(1).withColumns(
        {"STORE_LATITUDE": F.lit(45.0000001), "STORE_LONGITUDE": F.lit(-79.0), "REVENUE_CY": F.lit(3.0)})
    stores = stores.unionByName(one)
    pairs = att.attraction(stores, codes)
    want = {r[0]: r[1] for r in pairs.groupBy("POSTALCODE").agg(F.sum("Attraction")).collect()}
    sums = sp.postal_totals(codes, sp.with_cells(stores), small=small)
    got = {r.POSTALCODE: r.TOTAL_POSTALCODE_ATTRACTION for r in sums.collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for code, total in want.items():
        assert (got[code] is None) == (total is None), code
        assert total is None or math.isclose(got[code], total, rel_tol=1e-10, abs_tol=1e-12), code


def test_totals_make_no_row_per_pair(spark, sf_small):
    plan = sp.pruned_shares(inputs.stores(spark, sf_small), inputs.ldu(spark, sf_small), 0.01)._jdf.queryExecution().toString()
    sums = plan[plan.index("== Physical Plan =="):]
    assert "MapInArrow" in sums and not re.search(r"partial_sum\(try_divide|partial_sum\(__a.*POWER", sums)


def test_no_full_pairs_beyond_the_broadcast_bound(spark, sf_mid):
    stores, codes = inputs.stores(spark, sf_mid), inputs.ldu(spark, sf_mid)
    spark.conf.set("catchment.broadcast.maxBytes", "10")
    try:
        plan = sp.pruned_shares(stores, codes, att.HALF_PERCENT)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("catchment.broadcast.maxBytes")
    assert "__ky" in plan and "__lb" not in plan  # joined by cell, not province by province


def test_pairs_made_follow_the_pairs_kept(spark):
    """Four times the stores in the same place of the map: a postal code keeps
    about as many, and about as many are made for it."""
    made_pairs = []
    for count in (400, 1600):
        rng = random.Random(11)
        rows = [(*(f"{c}{i}" for c in STORE[:5]), "ON", *(f"{c}{i}" for c in STORE[6:]),
                 rng.uniform(44, 46), rng.uniform(-80, -78), rng.uniform(1.0, 2.0)) for i in range(count)]
        text = ", ".join(f"{c} string" for c in STORE)
        stores = spark.createDataFrame(rows, f"{text}, STORE_LATITUDE double, STORE_LONGITUDE double, REVENUE_CY double")
        codes = spark.createDataFrame([(f"P{i}", "ON", rng.uniform(44.2, 45.8), rng.uniform(-79.8, -78.2)) for i in range(40)],
                                      "POSTALCODE string, PROV string, LATITUDE double, LONGITUDE double")
        made_pairs.append(sp.pruned_pairs(stores, codes, att.HALF_PERCENT).count())
        same(sp.pruned_shares(stores, codes, att.HALF_PERCENT), att.shares(att.full_attraction(stores, codes)))
    assert made_pairs[1] < 1.5 * made_pairs[0], made_pairs


def test_the_rest_of_the_pull_is_smooth_and_right():
    """Over many stores of a block the pull is one over the haversine less a
    series, which is summed at few points: no arc sine per pair."""
    rest = sp.rest_of_pull()
    for h in (1e-3, 0.02, 0.1, sp.SPLIT):
        want = 1 / h - 1 / math.asin(math.sqrt(h)) ** 2
        assert math.isclose(sum(r * h**k for k, r in enumerate(rest)), want, abs_tol=1e-15 / h + 1e-13)
    assert rest[-1] * sp.SPLIT ** len(rest) < 1e-15


@pytest.mark.parametrize("odd", [None, "far", "negative", "nan"])
def test_totals_of_many_stores_equal_sums_over_all_pairs(spark, odd):
    rng = random.Random(12)
    places = [(rng.uniform(44, 50), rng.uniform(-90, -70), rng.uniform(0.0, 9e3)) for _ in range(1500)]
    places[7] = (45.5, -80.0, 1e12)  # a heavy store at the very place of a code
    places[8] = {"negative": (46.0, -81.0, -7e5), "nan": (46.0, -81.0, math.nan)}.get(odd, (46.0, -81.0, 1.0))
    stores = spark.createDataFrame(
        [(*(f"{c}{i}" for c in STORE[:5]), "ON", *(f"{c}{i}" for c in STORE[6:]), *place) for i, place in enumerate(places)],
        f"{', '.join(f'{c} string' for c in STORE)}, STORE_LATITUDE double, STORE_LONGITUDE double, REVENUE_CY double")
    codes = [(f"P{i}", "ON", rng.uniform(43, 52), rng.uniform(-95, -65)) for i in range(60)]
    codes += [("SAME", "ON", 45.5, -80.0), ("CLOSE", "ON", 45.5, -80.0000001), ("NULL", "ON", None, -80.0)]
    codes += [("FAR", "ON", -33.9, 151.2)] if odd == "far" else []
    codes = spark.createDataFrame(codes, "POSTALCODE string, PROV string, LATITUDE double, LONGITUDE double").coalesce(1)
    want = {r[0]: r[1] for r in att.attraction(stores, codes).groupBy("POSTALCODE").agg(F.sum("Attraction")).collect()}
    sums = sp.postal_totals(codes, sp.with_cells(stores), partitions=1)
    got = {r.POSTALCODE: r.TOTAL_POSTALCODE_ATTRACTION for r in sums.collect()}
    assert got.keys() == want.keys() and len(got) >= 63
    for code, total in want.items():
        assert (got[code] is None) == (total is None), code
        assert total is None or got[code] == pytest.approx(total, rel=1e-9 if code == "CLOSE" else 1e-13, nan_ok=True), code
