"""Benchmarks of a store profile: banner / region-channel / region / channel
values, each store's share of its category at those levels, category totals,
store values and medians.

Layout:
* The four level values are ratios of sums.  One aggregation over the
  grouping sets of all levels makes them, with partial sums before the
  shuffle, and they are joined back on their keys; no task holds all stores
  of a variable and year.
* The percent denominators are keyed by store name and category, whose size
  is not bounded by a dimension (a name may be shared by many stores).  They
  are grouped aggregates (partial aggregation before the shuffle) joined back
  on their keys, so a hot key is never gathered in one task.
* The profile is read more than once (sums and rows, four denominators, the
  category totals, the Basics self-join); it and the sums are written once,
  as the source pipeline writes and re-reads its stage table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..plans.layout import join_keyed, materialize, prefix_sums
from .profiles import RECENT_IMMIGRATION

# (value column, window keys); every key list contains variable and YEAR.
LEVEL_VALUES = [
    ("BANNER_VALUE", ["BANNER", "variable", "YEAR"]),
    ("CHANNEL_RE_VALUE", ["Region", "CHANNEL", "variable", "YEAR"]),
    ("REGION_VALUE", ["Region", "variable", "YEAR"]),
    ("CHANNEL_VALUE", ["CHANNEL", "variable", "YEAR"]),
]

# (percent column, value column, keys).  The region percent has no YEAR key:
# its denominator adds every year of the category (source behaviour; pass
# ``per_year=True`` to ``level_percents`` to key it by year as well).
LEVEL_PERCENTS = [
    ("BANNER_VALUE_PERCENT", "BANNER_VALUE", ["Category", "BANNER", "STORE_NAME", "YEAR"]),
    ("CHANNEL_RE_VALUE_PERCENT", "CHANNEL_RE_VALUE", ["Region", "CHANNEL", "STORE_NAME", "Category", "YEAR"]),
    ("REGION_VALUE_PERCENT", "REGION_VALUE", ["Region", "STORE_NAME", "Category"]),
    ("CHANNEL_VALUE_PERCENT", "CHANNEL_VALUE", ["CHANNEL", "STORE_NAME", "Category", "YEAR"]),
]


def level_sums(profile: DataFrame, levels) -> DataFrame:
    """Ratios of all levels in one aggregation: a row per level (``__level``,
    its place in ``levels``) and key, with the columns that are not its keys
    null.  One expand over the levels' grouping sets and partial sums before
    the only shuffle, so a variable that every store has is combined in the
    tasks that hold its rows."""
    columns = list(dict.fromkeys(c for _, keys in levels for c in keys))
    # grouping_id() has a bit per grouping column, the first the highest, set where it is not a key
    ids = [sum((c not in keys) << (len(columns) - 1 - i) for i, c in enumerate(columns)) for _, keys in levels]
    sets = profile.groupingSets([[F.col(c) for c in keys] for _, keys in levels], *[F.col(c) for c in columns])
    ratio = F.try_divide(F.sum("val"), F.sum("TOTAL_POPULATION"))
    summed = sets.agg(F.grouping_id().alias("__id"), ratio.alias("__ratio"))
    level = F.array_position(F.array(*map(F.lit, ids)), F.col("__id").cast("int")) - 1
    return summed.select(*columns, "__ratio", level.alias("__level"))


def level_values(profile: DataFrame, levels=None) -> DataFrame:
    """Add the level value columns (sum(val) / sum(TOTAL_POPULATION) over
    each level's keys): the profile is written once, summed for all levels in
    one aggregation, and the sums are joined back on their keys."""
    levels = LEVEL_VALUES if levels is None else levels
    profile = materialize(profile)
    sums, out = materialize(level_sums(profile, levels)), profile
    for place, (name, keys) in enumerate(levels):
        one = sums.filter(F.col("__level") == place).select(*keys, F.col("__ratio").alias(name))
        out = join_keyed(out, one, keys)
    return out


def level_percents(df: DataFrame, percents=None, per_year: bool = False) -> DataFrame:
    """Add each percent: the level value over the sum of the level value of
    the leaf variables (LEAF_NODE_FLAG = 1) sharing the percent's keys.

    Every denominator is a grouped aggregate of ``df`` itself (not of the
    frame with the previous denominators joined), so the plan reads ``df``
    once per denominator instead of doubling with every join; pass a
    materialized ``df`` (see ``plans.layout.materialize``).
    """
    percents = LEVEL_PERCENTS if percents is None else percents
    out = df
    for name, value, keys in percents:
        if per_year and "YEAR" not in keys:
            keys = keys + ["YEAR"]
        leaf_sum = F.sum(F.when(F.col("LEAF_NODE_FLAG") == 1, F.col(value)).otherwise(F.lit(0.0)))
        den = df.groupBy(*keys).agg(leaf_sum.alias(f"__den_{name}"))
        out = join_keyed(out, den, keys)
        out = out.withColumn(name, F.try_divide(F.col(value), F.col(f"__den_{name}"))).drop(f"__den_{name}")
    return out


def null_coordinates(df: DataFrame) -> DataFrame:
    """LONGITUDE / LATITUDE placeholders (typed NULL doubles)."""
    return df.withColumn("LONGITUDE", F.lit(None).cast("double")).withColumn("LATITUDE", F.lit(None).cast("double"))


def category_totals(profile: DataFrame) -> DataFrame:
    """TOTAL_CATEGORY: profile value of the category's total variable
    (TOTAL_FLAG = 1) per store and year."""
    return profile.filter(F.col("TOTAL_FLAG") == 1).select(
        "STORE_NAME", "STORE_NUM", "Category", "YEAR", F.col("val").alias("TOTAL_CATEGORY")
    )


def attach_category_total(profile: DataFrame, totals_from: DataFrame | None = None) -> DataFrame:
    """Left join of the category totals on (Category, STORE_NUM, STORE_NAME,
    YEAR).  Several total variables in one category repeat the row once per
    total, as the source join does.  ``totals_from`` is the table the totals
    are read from (default: ``profile``; any earlier stage with the same
    val / TOTAL_FLAG rows gives the same totals)."""
    source = profile if totals_from is None else totals_from
    totals = category_totals(source)
    return profile.join(totals, ["Category", "STORE_NUM", "STORE_NAME", "YEAR"], "left")


def store_value(df: DataFrame) -> DataFrame:
    """STORE_VALUE: val over TOTAL_HOUSEHOLD_POPULATION for the recent
    immigration description, else over TOTAL_CATEGORY; 0 for rows that are
    neither a leaf nor a total."""
    v = F.when(
        F.col("Description") == RECENT_IMMIGRATION, F.try_divide(F.col("val"), F.col("TOTAL_HOUSEHOLD_POPULATION"))
    ).otherwise(F.try_divide(F.col("val"), F.col("TOTAL_CATEGORY")))
    v = F.when((F.col("LEAF_NODE_FLAG") == 0) & (F.col("TOTAL_FLAG") == 0), F.lit(0.0)).otherwise(v)
    return df.withColumn("STORE_VALUE", v)


def demographic_benchmarks(profile: DataFrame, per_year: bool = False, with_values: DataFrame | None = None) -> DataFrame:
    """Profile with the four level percents (the level values themselves are
    dropped, as in the published table).  ``level_values`` has written the
    profile and its sums, which feed the four denominators."""
    if with_values is None:
        with_values = level_values(null_coordinates(profile))
    with_pct = level_percents(with_values, per_year=per_year)
    return with_pct.drop(*[name for name, _ in LEVEL_VALUES])


def demographic_store_table(profile: DataFrame, per_year: bool = False) -> DataFrame:
    """The published demographic store table: benchmarks, category totals and
    store values, in the 28-column layout.  The profile and sums written by
    ``level_values`` feed the denominators and the category totals, so the
    pairs and the melt run once."""
    with_values = level_values(null_coordinates(profile))
    bench = demographic_benchmarks(profile, per_year, with_values)
    valued = store_value(attach_category_total(bench, totals_from=with_values))
    return valued.drop("MEDIAN_AVERAGE", "LEAF_NODE_FLAG", "TOTAL_FLAG").select(*schemas.PROFILE_FINAL_COLUMNS)


# ---------------------------------------------------------------------------
# Social values
# ---------------------------------------------------------------------------
# Fixed value: category whose rows are the social-value totals.
BASICS = "Basics"


def basics_totals(profile: DataFrame) -> DataFrame:
    """Basics rows of the social-value profile as TOTAL_CATEGORY per store."""
    return profile.filter(F.col("Category") == BASICS).select(
        "STORE_NAME", "STORE_NUM", F.col("val").alias("TOTAL_CATEGORY")
    )


def attach_basics_total(profile: DataFrame, match_year: bool = False) -> DataFrame:
    """Left join of the Basics totals on (STORE_NUM, STORE_NAME).  Without
    ``match_year`` (source behaviour) every row repeats once per Basics row of
    the store, across years; with it the join also keys on YEAR."""
    if match_year:
        totals = profile.filter(F.col("Category") == BASICS).select(
            "STORE_NAME", "STORE_NUM", "YEAR", F.col("val").alias("TOTAL_CATEGORY")
        )
        keys = ["STORE_NUM", "STORE_NAME", "YEAR"]
    else:
        totals = basics_totals(profile)
        keys = ["STORE_NUM", "STORE_NAME"]
    return profile.join(totals, keys, "left")


def social_store_value(df: DataFrame) -> DataFrame:
    return df.withColumn("STORE_VALUE", F.try_divide(F.col("val"), F.col("TOTAL_CATEGORY")))


def social_benchmarks(profile: DataFrame) -> DataFrame:
    """Social-value profile with the four level values (no percents)."""
    return level_values(null_coordinates(profile))


def social_store_table(profile: DataFrame, match_year: bool = False) -> DataFrame:
    """Social-value store table; the self-join on Basics totals reads what
    ``level_values`` has written."""
    bench = social_benchmarks(profile)
    return social_store_value(attach_basics_total(bench, match_year))


def exact_medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Interpolated median of ``value`` for each group of ``keys``, by rank.

    Equal values are counted first (partial aggregation, so copies collapse
    before the shuffle); their running counts (``layout.prefix_sums``) give
    each value the ranks it holds, and the one or two middle ranks are picked.
    A group is spread over range pieces: none is held by one task.  NULLs are
    not counted; a group of NULLs alone has a NULL median."""
    counted = materialize(df.groupBy(*keys, value).agg(F.count(value).alias("__n")))
    totals = counted.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    rows = join_keyed(prefix_sums(counted, keys, [value], "__n", "__upto"), totals, keys)
    last, total = F.col("__upto"), F.col("__total")

    def at(rank):
        return F.max(F.when((last - F.col("__n") < rank) & (rank <= last), F.col(value)))

    middle = at(F.floor((total + 1) / 2)) + at(F.floor(total / 2) + 1)
    return rows.groupBy(*keys).agg((middle / 2).alias(name))


def median_by(df: DataFrame, level: str, value: str, exact: bool = False) -> DataFrame:
    """Median of ``value`` per (Description, level): ``percentile_approx``
    (an element of the data, as in the source) or the exact interpolated
    median (``exact_medians``)."""
    if exact:
        return exact_medians(df, ["Description", level], value, f"Median_{value}")
    return df.groupBy("Description", level).agg(F.percentile_approx(value, 0.5).alias(f"Median_{value}"))


def level_entries(df: DataFrame, levels: list[tuple[str, str]], digits: int | None = None) -> DataFrame:
    """(LEVEL, LEVEL_VALUE, Description, v): each row once for each (level
    column, value column) pair."""
    entries = F.array(*[
        F.struct(
            F.lit(level).alias("LEVEL"),
            F.col(level).alias("LEVEL_VALUE"),
            (F.col(value) if digits is None else F.round(value, digits)).alias("v"),
        )
        for level, value in levels
    ])
    return df.select("Description", F.explode(entries).alias("e")).select("e.*", "Description")


def medians_by(df: DataFrame, levels: list[tuple[str, str]]) -> DataFrame:
    """(LEVEL, LEVEL_VALUE, Description, MEDIAN) of several (level column,
    value column) pairs in one aggregation: each row once per level."""
    rows = level_entries(df, levels)
    return rows.groupBy("LEVEL", "LEVEL_VALUE", "Description").agg(F.percentile_approx("v", 0.5).alias("MEDIAN"))
