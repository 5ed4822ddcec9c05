"""Leave-one-out competition invariants and the wide / long equivalence."""

import pytest
from pyspark.sql import functions as F

from catchment import schemas
from catchment.operators import competition as comp


def shares_df(spark, rows):
    """rows: (store, banner, postal, attraction)."""
    full = []
    for store, banner, pc, a in rows:
        r = {c: None for c in schemas.SHARE_COLUMNS}
        r.update(STORE_NUM=store, STORE_NAME=f"S{store}", BANNER=banner, POSTALCODE=pc, Attraction=a, CHANNEL="GROCERY")
        full.append(r)
    df = spark.createDataFrame(
        [tuple(r[c] for c in ["STORE_NUM", "STORE_NAME", "BANNER", "CHANNEL", "POSTALCODE", "Attraction"]) for r in full],
        "STORE_NUM long, STORE_NAME string, BANNER string, CHANNEL string, POSTALCODE string, Attraction double",
    )
    from catchment.operators.attraction import renormalise

    return renormalise(df)


def test_single_banner_postal_code_gives_zeros(spark):
    s = shares_df(spark, [(1, "B1", "P1", 10.0), (2, "B1", "P1", 5.0)])
    rows = comp.leave_one_out(s).collect()
    assert len(rows) == 2 and all(r.EXCLUDED_ATTRACTION == 0.0 for r in rows)


def test_absent_banner_generates_no_rows_and_shares_sum_to_one(spark):
    s = shares_df(
        spark,
        [(1, "B1", "P1", 10.0), (2, "B2", "P1", 5.0), (3, "B3", "P1", 5.0), (4, "B1", "P2", 7.0), (5, "B2", "P2", 3.0)],
    )
    long = comp.leave_one_out(s)
    assert long.filter((F.col("POSTALCODE") == "P2") & (F.col("EXCLUDED_BANNER") == "B3")).count() == 0
    sums = long.groupBy("POSTALCODE", "EXCLUDED_BANNER").agg(F.sum("EXCLUDED_ATTRACTION").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-12 for r in sums)
    # excluded banner's own rows stay with 0
    own = long.filter(F.col("BANNER") == F.col("EXCLUDED_BANNER")).collect()
    assert own and all(r.EXCLUDED_ATTRACTION == 0.0 for r in own)


def test_null_banner_counts_for_no_one(spark):
    s = shares_df(spark, [(1, "B1", "P1", 10.0), (2, None, "P1", 5.0), (3, "B2", "P1", 5.0)])
    long = comp.leave_one_out(s)
    excluded = {r.EXCLUDED_BANNER for r in long.collect()}
    assert excluded == {"B1", "B2"}
    r = long.filter((F.col("STORE_NUM") == 1) & (F.col("EXCLUDED_BANNER") == "B2")).first()
    assert abs(r.EXCLUDED_ATTRACTION - 1.0) < 1e-12  # NULL-banner store not in the denominator


def test_banner_with_space_and_underscore_are_kept_apart(spark):
    s = shares_df(spark, [(1, "A B", "P1", 10.0), (2, "A_B", "P1", 5.0)])
    long = comp.leave_one_out(s).collect()
    # both are excluded separately (their labels coincide, the comparisons
    # use the real values): each store is 0 once and 1 once
    assert len(long) == 4
    assert sorted(r.EXCLUDED_ATTRACTION for r in long) == [0.0, 0.0, 1.0, 1.0]


def test_long_equals_wide_then_unpivot_then_affected(spark, sf_small):
    from catchment.plans import inputs

    s = inputs.one_pct(spark, sf_small)
    cols = ["STORE_NUM", "POSTALCODE", "EXCLUDED_BANNER", "EXCLUDED_ATTRACTION"]
    a = sorted((r[0], r[1], r[2], round(r[3], 9)) for r in comp.affected(comp.leave_one_out(s)).select(*cols).collect())
    b = sorted((r[0], r[1], r[2], round(r[3], 9)) for r in comp.affected(comp.competition_long(s)).select(*cols).collect())
    assert a == b and len(a) > 0
    wide = comp.competition_wide(s)
    names = [c for c in wide.columns if c.startswith(comp.PREFIX)]
    one = {(r.STORE_NUM, r.POSTALCODE): r for r in wide.collect()}
    for store, postal, label, value in b:
        assert round(one[store, postal][comp.PREFIX + label], 9) == value
    assert len(names) == len({r[2] for r in b})


AWKWARD = [(1, "ST. JOHN", "P1", 10.0), (2, "A B", "P1", 5.0), (3, "A_B", "P1", 5.0), (4, "CHANNEL", "P1", 20.0), (5, "A B", "P2", 1.0)]


def test_long_form_takes_any_banner_name(spark):
    rows = comp.competition_long(shares_df(spark, AWKWARD)).collect()
    assert len(rows) == 5 * 4 and {r.EXCLUDED_VALUE for r in rows} == {"ST. JOHN", "A B", "A_B", "CHANNEL"}
    got = {(r.STORE_NUM, r.EXCLUDED_VALUE): r.EXCLUDED_ATTRACTION for r in rows}
    assert got[1, "A B"] == 10 / 35 and got[1, "A_B"] == 10 / 35 and got[1, "ST. JOHN"] == 0
    assert got[4, "ST. JOHN"] == 20 / 30 and got[5, "CHANNEL"] == 1.0
    present = {(r.STORE_NUM, r.EXCLUDED_VALUE) for r in comp.leave_one_out(shares_df(spark, AWKWARD)).collect()}
    assert present == {k for k in got if k[0] < 5} | {(5, "A B")}


def test_wide_form_names(spark):
    wide = comp.competition_wide(shares_df(spark, [r for r in AWKWARD if r[1] != "A_B"]))
    assert comp.PREFIX + "ST._JOHN" in wide.columns and wide.count() == 4
    with pytest.raises(ValueError, match="A_B"):
        comp.competition_wide(shares_df(spark, AWKWARD))
