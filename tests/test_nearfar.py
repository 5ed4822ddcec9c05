import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment import schemas
from catchment.operators import attraction as att
from catchment.operators import nearfar as nf
from catchment.operators import spatial as sp


def inverse(lat, lon, lats, lons, mass):
    dy, dx = (np.radians(a - b[:, None]) / 2 for a, b in ((lats, lat), (lons, lon)))
    h = np.sin(dy) ** 2 + np.sin(dx) ** 2 * np.cos(np.radians(lats)) * np.cos(np.radians(lat))[:, None]
    apart = h > 0
    return np.divide(mass, h, out=np.zeros_like(h), where=apart).sum(axis=1), apart.sum(axis=1)


def places(kind, count, seed):
    rng = np.random.default_rng(seed)
    if kind == "towns":
        town = rng.integers(0, 12, count)
        spots = np.random.default_rng(99).uniform((43, -100), (53, -60), (12, 2))
        return (spots[town] + 0.2 * rng.standard_normal((count, 2))).T
    if kind == "line":
        return np.full(count, 45.0), rng.uniform(-100, -60, count)
    if kind == "date line":
        return rng.uniform(43, 53, count), (rng.uniform(170, 200, count) + 180) % 360 - 180
    return rng.uniform((43, -100), (53, -60), (count, 2)).T


@pytest.mark.parametrize("kind", ["even", "towns", "line", "date line", "one place"])
def test_sums_equal_those_of_all_pairs(monkeypatch, kind):
    monkeypatch.setattr(nf, "LEAF", 32)
    monkeypatch.setattr(nf, "FEW_PAIRS", 2048)
    lats, lons = places(kind, 3000, 1)
    if kind == "one place":
        lats, lons = np.full(3000, 45.0), np.full(3000, -80.0)
    lat, lon = places(kind, 700, 2)
    lat[:3], lon[:3] = lats[:3], lons[:3]  # at the very place of a store
    lat[3], lon[3] = lats[3], lons[3] + 1e-6
    mass = np.random.default_rng(3).uniform(0, 9e3, 3000)
    sums = nf.inverse_haversine_sums(1e-8)()
    want, apart = inverse(lat, lon, lats, lons, mass)
    for _ in range(2):  # the second time with the kept boxes
        got, found = sums(lat, lon, lats, lons, mass, 1)
        assert (found == apart).all()
        assert got == pytest.approx(want, rel=1e-11, abs=1e-300)
    assert sums(np.array([-45.0]), np.array([110.0]), lats, lons, mass, 1) is None or kind == "date line"


def test_terms_grow_slower_than_pairs(monkeypatch):
    """Four times the codes and stores over the same place: sixteen times the
    pairs, but far fewer terms."""
    terms = []
    real = np.divide

    def counted(a, b, *more, **named):
        if np.ndim(b) == 2 and np.ndim(a) == 0:
            terms[-1] += b.size
        return real(a, b, *more, **named)

    monkeypatch.setattr(np, "divide", counted)
    for count in (8000, 32000):
        lat, lon = np.random.default_rng(5).uniform((47, -82), (49, -78), (count // 4, 2)).T
        terms.append(0)
        lats, lons = places("even", count, 6)
        nf.inverse_haversine_sums(1e-8)()(lat, lon, lats, lons, np.ones(count), 1)
        assert 0 < terms[-1] < 0.5 * len(lat) * count
    assert terms[1] < 10 * terms[0], terms


def test_tasks_get_the_sums_by_value():
    begin = nf.inverse_haversine_sums(1e-8)
    assert "<locals>" in begin.__qualname__ and not [g for g in inspect.getclosurevars(begin).globals]


def test_totals_by_boxes_equal_sums_over_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nf, "LEAF", 32)
    monkeypatch.setattr(nf, "FEW_PAIRS", 1024)
    rng = random.Random(7)
    text = "STORE_NUM STORE_NAME BANNER STORE_STREET POSTAL_CODE STORE_PROVINCE CUSTOMER_GROUP CHANNEL SALES_GROUP".split()
    rows = [(*(f"{c}{i}" for c in text[:5]), rng.choice(["ON", "QC"]), *(f"{c}{i}" for c in text[6:]),
             rng.uniform(44, 50), rng.uniform(-90, -70), rng.uniform(0.0, 9e3)) for i in range(3000)]
    schema = f"{', '.join(f'{c} string' for c in text)}, STORE_LATITUDE double, STORE_LONGITUDE double, REVENUE_CY double"
    stores = spark.createDataFrame(rows, schema)
    codes = [(f"P{i}", rng.choice(["ON", "QC", "MB"]), rng.uniform(43, 52), rng.uniform(-95, -65)) for i in range(200)]
    codes += [("SAME", "ON", *rows[0][9:11]), ("NULL", "ON", None, -80.0), ("NAN", "ON", float("nan"), -80.0), ("NONE", None, 45.0, -80.0)]
    codes = spark.createDataFrame(codes, "POSTALCODE string, PROV string, LATITUDE double, LONGITUDE double")
    pairs = att.attraction(stores, codes)
    want = {r[0]: r[1] for r in pairs.groupBy("POSTALCODE").agg(F.sum("Attraction")).collect()}
    for small in (True, False):
        sums = sp.postal_totals(codes, sp.with_cells(stores), partitions=2, small=small)
        got = {r.POSTALCODE: r.TOTAL_POSTALCODE_ATTRACTION for r in sums.collect()}
        assert got.keys() == want.keys() and len(got) == 203
        assert got["NULL"] is want["NULL"] is None
        for code in want.keys() - {"NULL", "NAN"}:
            assert got[code] == pytest.approx(want[code], rel=1e-11), code
    kept = sp.pruned_shares(stores, codes, 0.01).select(*schemas.SHARE_COLUMNS[:1]).count()
    assert kept == att.shares(att.full_attraction(stores, codes), 0.01).count() > 100
