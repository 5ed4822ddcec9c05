"""Queries: leave-one-out competition (long, wide, affected rows, top-k)."""

from __future__ import annotations

from .. import schemas
from ..operators import competition as comp
from ..queries import register
from . import inputs

SHARES = schemas.SHARE_COLUMNS
LONG = SHARES + ["EXCLUDED_BANNER", "EXCLUDED_VALUE", "EXCLUDED_ATTRACTION"]

# Banner values of the store fixture (the wide form has one column each).
FIXTURE_BANNERS = ["FRESH MART", "VALUE STOP", "CITY GROCER", "PRIME", "CLUB", "LOCAL CO"]


def _present_sql(level: str) -> str:
    """Oracle: rows x level values present in the same postal code."""
    return f"""SELECT * FROM (
  SELECT f.*, replace(b.EXCLUDED, ' ', '_') AS EXCLUDED_BANNER, b.EXCLUDED AS EXCLUDED_VALUE,
    CASE WHEN f.{level} <> b.EXCLUDED THEN f.Attraction / nullif(sum(CASE WHEN f.{level} <> b.EXCLUDED THEN f.Attraction ELSE 0 END)
      OVER (PARTITION BY f.POSTALCODE, b.EXCLUDED), 0) ELSE 0 END AS EXCLUDED_ATTRACTION
  FROM att_onep f JOIN (SELECT DISTINCT POSTALCODE, {level} AS EXCLUDED FROM att_onep WHERE {level} IS NOT NULL) b
    ON f.POSTALCODE = b.POSTALCODE) x
WHERE PERCENT_ATTRACTION <> EXCLUDED_ATTRACTION"""


@register("competition_affected", LONG, _present_sql("BANNER"))
def competition_affected(spark, sf):
    """WIN-6 / JOIN-9 / F-13 / CTL-1: leave-one-banner-out shares, affected rows only."""
    return comp.affected(comp.leave_one_out(inputs.one_pct(spark, sf), "BANNER"))


@register("competition_channel", LONG, _present_sql("CHANNEL"))
def competition_channel(spark, sf):
    """Leave-one-channel-out competition (level parameter)."""
    return comp.affected(comp.leave_one_out(inputs.one_pct(spark, sf), "CHANNEL"))


@register("competition_customer_group", LONG, _present_sql("CUSTOMER_GROUP"))
def competition_customer_group(spark, sf):
    """Leave-one-customer-group-out competition (level parameter)."""
    return comp.affected(comp.leave_one_out(inputs.one_pct(spark, sf), "CUSTOMER_GROUP"))


def _wide_sql() -> str:
    cols = ",\n  ".join(
        f"CASE WHEN BANNER <> '{b}' THEN Attraction / nullif(sum(CASE WHEN BANNER <> '{b}' THEN Attraction ELSE 0 END)"
        f" OVER (PARTITION BY POSTALCODE), 0) ELSE 0 END AS COMPETITION_ATTRACTION_{b.replace(' ', '_')}"
        for b in FIXTURE_BANNERS
    )
    return f"SELECT *,\n  {cols}\nFROM att_onep"


WIDE = SHARES + ["COMPETITION_ATTRACTION_" + b.replace(" ", "_") for b in FIXTURE_BANNERS]


@register("competition_wide", WIDE, _wide_sql())
def competition_wide(spark, sf):
    """WIN-6 (wide): one leave-one-out share column per banner."""
    return comp.competition_wide(inputs.one_pct(spark, sf), "BANNER")


LONG_ALL_SQL = """SELECT f.*, replace(b.B, ' ', '_') AS EXCLUDED_BANNER, b.B AS EXCLUDED_VALUE,
  CASE WHEN f.BANNER <> b.B THEN f.Attraction / nullif(sum(CASE WHEN f.BANNER <> b.B THEN f.Attraction ELSE 0 END)
    OVER (PARTITION BY f.POSTALCODE, b.B), 0) ELSE 0 END AS EXCLUDED_ATTRACTION
FROM att_onep f CROSS JOIN (SELECT DISTINCT BANNER AS B FROM att_onep WHERE BANNER IS NOT NULL) b"""


@register("competition_long", LONG, LONG_ALL_SQL)
def competition_long(spark, sf):
    """RSH-4 / CTL-2 / FN-11: every share row once per banner, before the
    affected-rows filter."""
    return comp.competition_long(inputs.one_pct(spark, sf), "BANNER")


TOP_KEYS = ["POSTALCODE", "STORE_NUM", "STORE_NAME", "EXCLUDED_VALUE"]


@register(
    "competition_top",
    LONG,
    f"SELECT * FROM ({_present_sql('BANNER')}) t ORDER BY {', '.join(TOP_KEYS)} LIMIT 100",
)
def competition_top(spark, sf):
    """SRT-4: the first 100 affected competition rows in key order (top-k report)."""
    return comp.top(comp.affected(comp.leave_one_out(inputs.one_pct(spark, sf), "BANNER")), 100, TOP_KEYS)
