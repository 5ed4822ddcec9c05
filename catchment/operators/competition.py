"""Leave-one-out competition: how each store's share of a postal code moves
when one banner (or channel, or customer group) leaves the market.

For a row of store s in postal code p and an excluded value B of the level
column, EXCLUDED_ATTRACTION is 0 when s itself belongs to B, else s's
attraction over the attraction of the stores of p outside B.  NULL level
values count for no one (they are never an excluded value and never in a
denominator), as in the source computation.

The long result only keeps (row, B) combinations where B is present in the
row's postal code: for any other B the denominator is unchanged, so the share
equals PERCENT_ATTRACTION and the row is not affected.  Generating only
present values replaces the per-banner driver loop of the source pipeline:
the postal code's rows are joined to the distinct level values of the same
postal code (after a 1% cut a postal code has at most 99 rows, so this fan-out
is bounded), and everything stays partitioned by POSTALCODE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excluded_label
from ..plans.layout import materialize

LEVELS = ("BANNER", "CHANNEL", "CUSTOMER_GROUP")


def _check_level(level: str) -> None:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, got {level!r}")


def leave_one_out(shares: DataFrame, level: str = "BANNER") -> DataFrame:
    """Long competition rows: every share row once per level value present in
    its postal code, with EXCLUDED_BANNER (label, spaces as underscores),
    EXCLUDED_VALUE (the value itself: labels may coincide) and
    EXCLUDED_ATTRACTION.  These are exactly the affected rows.

    One pass over rows partitioned by POSTALCODE, no self-join: a window per
    (postal code, value) gives that value's attraction S_B, a window per
    postal code gives the total T and the set of (value, S_B) present (at most
    one entry per distinct value of the level: a small dimension), which is
    exploded; the denominator without B is T - S_B.
    """
    _check_level(level)
    lvl = F.col(level)
    counted = F.when(lvl.isNotNull(), F.col("Attraction")).otherwise(F.lit(0.0))
    by_postal = Window.partitionBy("POSTALCODE")
    by_value = Window.partitionBy("POSTALCODE", level)
    with_sets = shares.select(
        *shares.columns,
        F.sum(counted).over(by_postal).alias("__total"),
        F.collect_set(
            F.when(lvl.isNotNull(), F.struct(lvl.alias("value"), F.sum(counted).over(by_value).alias("att")))
        ).over(by_postal).alias("__present"),
    )
    exploded = with_sets.select(*shares.columns, "__total", F.explode("__present").alias("__b"))
    outside = lvl != F.col("__b.value")
    denom = F.col("__total") - F.col("__b.att")
    excluded_att = F.when(outside, F.try_divide(F.col("Attraction"), denom)).otherwise(F.lit(0.0))
    return exploded.select(
        *shares.columns,
        excluded_label("__b.value").alias("EXCLUDED_BANNER"),
        F.col("__b.value").alias("EXCLUDED_VALUE"),
        excluded_att.alias("EXCLUDED_ATTRACTION"),
    )


def affected(long_df: DataFrame) -> DataFrame:
    """Rows whose share changes when the excluded value leaves (exact float
    comparison, as in the source)."""
    return long_df.filter(F.col("PERCENT_ATTRACTION") != F.col("EXCLUDED_ATTRACTION"))


PREFIX = "COMPETITION_ATTRACTION_"


def _with_level_sums(shares: DataFrame, level: str) -> tuple[DataFrame, list]:
    """The shares with the postal code's total and its attraction by level
    value, and all level values.  The shares are written first, so listing
    the values does not run the pairs again."""
    _check_level(level)
    shares = materialize(shares)
    values = sorted(r[0] for r in shares.select(level).filter(F.col(level).isNotNull()).distinct().collect())
    lvl = F.col(level)
    counted = F.when(lvl.isNotNull(), F.col("Attraction")).otherwise(F.lit(0.0))
    by_postal = Window.partitionBy("POSTALCODE")
    own = F.sum(counted).over(Window.partitionBy("POSTALCODE", level))
    entries = F.collect_set(F.when(lvl.isNotNull(), F.struct(lvl.alias("value"), own.alias("att")))).over(by_postal)
    return shares.select(
        "*", F.sum(counted).over(by_postal).alias("__total"),
        F.count(F.when(lvl.isNull(), 1)).over(by_postal).alias("__nulls"), F.map_from_entries(entries).alias("__by_value")
    ), values


def _outside_share(level: str, value) -> Column:
    """The row's attraction over that of its postal code without ``value``;
    0 for rows of the value itself and rows without a level value.  A value
    that the postal code lacks changes nothing: the share stays as it is,
    unless stores without a level value leave the denominator."""
    without = F.try_element_at("__by_value", value)
    unchanged = without.isNull() & (F.col("__nulls") == 0)
    share = F.when(unchanged, F.col("PERCENT_ATTRACTION")).otherwise(
        F.try_divide(F.col("Attraction"), F.col("__total") - F.coalesce(without, F.lit(0.0)))
    )
    return F.when(F.col(level) != value, share).otherwise(F.lit(0.0))


def competition_wide(shares: DataFrame, level: str = "BANNER") -> DataFrame:
    """Wide form: one COMPETITION_ATTRACTION_<value> column per level value,
    spaces as underscores.  Values whose columns would have one name, or the
    name of a share column, raise: use ``competition_long`` then.

    A column is the row's attraction over the postal code's total less the
    value's own sum, so all columns share one window over POSTALCODE."""
    with_sums, values = _with_level_sums(shares, level)
    names = [PREFIX + v.replace(" ", "_") for v in values]
    taken = [n.lower() for n in (*names, *shares.columns)]
    clash = sorted({n for n in names if taken.count(n.lower()) > 1})
    if clash:
        raise ValueError(f"several {level} values have the wide column {', '.join(clash)}; use competition_long")
    cols = [_outside_share(level, F.lit(v)).alias(n) for v, n in zip(values, names, strict=True)]
    return with_sums.select(*[f"`{c}`" for c in shares.columns], *cols)


def competition_long(shares: DataFrame, level: str = "BANNER") -> DataFrame:
    """Long form of all combinations: every share row once per level value of
    any postal code, with EXCLUDED_BANNER (label), EXCLUDED_VALUE and
    EXCLUDED_ATTRACTION.  Values are data here, never column names."""
    with_sums, values = _with_level_sums(shares, level)
    each = with_sums.withColumn("EXCLUDED_VALUE", F.explode(F.array(*map(F.lit, values)).cast("array<string>")))
    return each.select(
        *shares.columns,
        excluded_label("EXCLUDED_VALUE").alias("EXCLUDED_BANNER"),
        "EXCLUDED_VALUE",
        _outside_share(level, F.col("EXCLUDED_VALUE")).alias("EXCLUDED_ATTRACTION"),
    )


def top(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """First ``n`` rows in ``keys`` order (a top-k report)."""
    return df.orderBy(*keys).limit(n)
