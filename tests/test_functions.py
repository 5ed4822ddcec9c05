import math

import pytest
from pyspark.sql import functions as F

from catchment.functions import codes, geo, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_haversine_zero_and_symmetric(spark):
    assert one(spark, geo.haversine_km(F.lit(45.0), F.lit(-75.0), F.lit(45.0), F.lit(-75.0))) == 0.0
    a = one(spark, geo.haversine_km(F.lit(43.65), F.lit(-79.38), F.lit(45.50), F.lit(-73.57)))
    b = one(spark, geo.haversine_km(F.lit(45.50), F.lit(-73.57), F.lit(43.65), F.lit(-79.38)))
    assert a == pytest.approx(b, rel=1e-12)
    # Toronto - Montreal great-circle distance is about 504 km.
    assert 495 < a < 510


def test_haversine_matches_python(spark):
    lat1, lon1, lat2, lon2 = 49.28, -123.12, 51.05, -114.07
    r = geo.EARTH_RADIUS_KM
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.sin(math.radians(lon2 - lon1) / 2) ** 2 * math.cos(
        math.radians(lat1)
    ) * math.cos(math.radians(lat2))
    expected = 2 * r * math.asin(math.sqrt(h))
    got = one(spark, geo.haversine_km(F.lit(lat1), F.lit(lon1), F.lit(lat2), F.lit(lon2)))
    assert got == pytest.approx(expected, rel=1e-12)


def test_gravity_zero_distance_is_null(spark):
    assert one(spark, geo.gravity(F.lit(100.0), F.lit(0.0))) is None
    assert one(spark, geo.gravity(F.lit(100.0), F.lit(2.0))) == 25.0


@pytest.mark.parametrize(
    "prov,region",
    [("ON", "ONTARIO"), ("QC", "QUEBEC"), ("AB", "WEST"), ("NT", "WEST"), ("PE", "EAST"), ("NU", "NU"), ("XX", "XX")],
)
def test_region(spark, prov, region):
    assert one(spark, codes.region(F.lit(prov))) == region


@pytest.mark.parametrize(
    "code,year", [("EHYBASPOP", 2018), ("ECYBASPOP", 2023), ("P3YX", 2026), ("P5YX", 2028), ("P0YX", 2033), ("NC24TR01", None)]
)
def test_year_from_code(spark, code, year):
    assert one(spark, codes.year_from_code(F.lit(code))) == year


def test_newcomer_year_and_suffix(spark):
    assert one(spark, codes.newcomer_year(F.lit("NC24TR01"))) == 2024
    assert one(spark, codes.newcomer_year(F.lit("ECYBASPOP"))) == 2023
    assert one(spark, codes.suffix_key(F.lit("ECYBASPOP"))) == "BASPOP"


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("Household Income ($0-$50) (Current Year $)", "Household Income 050"),
        ("Household Income, Over $50.", "Household Income Over 50"),
        ("Born in Côte d'Ivoire", "Born in Cote d Ivoire"),
        ("Plain text", "Plain text"),
    ],
)
def test_clean_description(spark, raw, clean):
    assert one(spark, text.clean_description(F.lit(raw))) == clean


@pytest.mark.parametrize(
    "group,name,chain",
    [
        ("AOL_AO LOCAL", "ACME #12 NORTH YORK FOODS", "ACME FOODS"),
        ("AON_AO NATL RETAIL", "BIG MART #7 OTTAWA", "BIG MART "),
        ("GROUP A", "ACME #12 NORTH YORK FOODS", "GROUP A"),
    ],
)
def test_store_chain(spark, group, name, chain):
    assert one(spark, text.store_chain(F.lit(group), F.lit(name))) == chain


def test_excluded_label(spark):
    assert one(spark, text.excluded_label(F.lit("FRESH MART"))) == "FRESH_MART"
