"""Store profiles: postal-code features weighted by each store's share.

profile(store, variable, year) = sum over postal codes of
PERCENT_ATTRACTION(store, postal) x value(postal, variable, year), and the
same weight on the population totals.

Layout: the join is on POSTALCODE.  On the share side a postal code has at
most 199 rows after the 0.5% cut (every kept store holds more than 0.5% of
the postal code), and on the feature side at most one row per variable and
year, so no join key can hold a large fraction of the data.  Features are
filtered before the join (the NULL cells of the dense melt never reach it)
and the grouped sums use partial aggregation before the shuffle.  Stores are
what the shares say they are: no store table is read again.  A keyed melted
table is summed by two integers, the store's number and the metadata group's;
the attributes of both are attached to the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import region
from ..functions.text import store_chain
from ..plans.layout import fits_broadcast, join_keyed, materialize, numbered
from .features import Melted

# Store attributes the profile is grouped by (a store may appear under more
# than one name; each combination is its own profile row).
STORE_KEYS = [
    "CUSTOMER_GROUP",
    "STORE_NAME",
    "STORE_NUM",
    "CHANNEL",
    "SALES_GROUP",
    "BANNER",
    "STORE_STREET",
    "STORE_LONGITUDE",
    "STORE_LATITUDE",
    "STORE_PROVINCE",
]

# ---------------------------------------------------------------------------
# Fixed values (must equal the source pipeline's): categories left out of the
# demographic profile, and the description whose store value is taken over
# the household population.
# ---------------------------------------------------------------------------
EXCLUDED_CATEGORIES = ["Trends", "Attitudes"]
RECENT_IMMIGRATION = "Household Population For Recent Immigration By Place Of Birth"

DEMO_SUMS = [
    "val",
    "TOTAL_HOUSEHOLDS",
    "TOTAL_HOUSEHOLD_POPULATION",
    "TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER",
    "TOTAL_POPULATION",
]
DEMO_DIMS = ["Hierarchy_Description", "MEDIAN_AVERAGE", "ADD_TO_PROFILE", "LEAF_NODE_FLAG", "TOTAL_FLAG"]

DEMO_PROFILE_COLUMNS = (
    ["CUSTOMER_GROUP", "STORE_NAME", "STORE_NUM", "CHANNEL", "SALES_GROUP", "BANNER", "STORE_STREET", "STORE_PROVINCE",
     "STORE_LATITUDE", "STORE_LONGITUDE", "variable", "Description", "Language_Grouping", "Category", "YEAR"]
    + DEMO_SUMS
    + DEMO_DIMS
)



def weighted_sums(
    shares: DataFrame, features: DataFrame, keys: list[str], sums: list[str], firsts=(), store_keys=tuple(STORE_KEYS)
) -> DataFrame:
    """Join shares to features on POSTALCODE and sum PERCENT_ATTRACTION x
    column for every column of ``sums``, grouped by ``store_keys`` (the store
    attributes as the shares carry them) and ``keys``.  Of the ``firsts`` one
    row's values are taken together (the smallest), where the source took any."""
    joined = shares.select("POSTALCODE", "PERCENT_ATTRACTION", *store_keys).join(
        features.select("POSTALCODE", *keys, *sums, *firsts), "POSTALCODE"
    )
    w = F.col("PERCENT_ATTRACTION")
    aggs = [F.sum(w * F.col(c)).alias(c) for c in sums]
    if not firsts:
        return joined.groupBy(*store_keys, *keys).agg(*aggs)
    one = joined.groupBy(*store_keys, *keys).agg(*aggs, F.min(F.struct(*firsts)).alias("__first"))
    return one.select(*store_keys, *keys, *sums, *[F.col(f"__first.{c}").alias(c) for c in firsts])


def numbered_stores(shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shares as (POSTALCODE, PERCENT_ATTRACTION, __sid), and the stores
    as (__sid, attributes): one row for each combination of attributes, NULLs
    included.  The shares are written first, so that finding their stores
    doesn't run the pairs again."""
    copy = materialize(shares.select("POSTALCODE", "PERCENT_ATTRACTION", *STORE_KEYS))
    stores = numbered(copy.select(*STORE_KEYS).distinct(), "__sid")
    coded = join_keyed(copy, stores, STORE_KEYS, "inner")
    return coded.select("POSTALCODE", "PERCENT_ATTRACTION", "__sid"), stores


def metadata_groups(meta: DataFrame, keys: list[str], firsts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(__mid -> __gid) and one row per __gid with ``keys`` and one variant of
    the ``firsts``: metadata rows that differ in pass-through attributes only
    are one group of the profile."""
    first = F.min(F.struct(F.lit(0).alias("__"), *firsts)).alias("__first")
    groups = meta.groupBy(*keys).agg(F.min("__mid").alias("__gid"), first)
    mids = join_keyed(meta.select("__mid", *keys), groups.select("__gid", *keys), keys).select("__mid", "__gid")
    return mids, groups.select("__gid", *keys, *[F.col(f"__first.{c}").alias(c) for c in firsts])


def profile(
    shares: DataFrame, melted: DataFrame | Melted, keys: list[str], sums: list[str], firsts=(), keep=None
) -> DataFrame:
    """Weighted profile by store and ``keys``; ``keep`` filters the features.

    One plan at every size: the shares are joined to the cells that hold a
    value on POSTALCODE and aggregated with partial sums before the shuffle of
    the sums.  A keyed melted table is grouped by one integer per store and
    one per metadata group, whose attributes are attached to the aggregated
    rows; a plain table by the attributes."""
    if not isinstance(melted, Melted):
        f = melted.filter(F.col("val").isNotNull())
        return weighted_sums(shares, f if keep is None else f.filter(keep), keys, sums, list(firsts))
    mids, groups = metadata_groups(melted.meta if keep is None else melted.meta.filter(keep), keys, list(firsts))
    cells = (melted.present if melted.present is not None else melted.keyed).filter(F.col("val").isNotNull())
    # Both are made of the metadata and no larger: broadcast while that measures small, else left to the planner.
    side = F.broadcast if fits_broadcast(melted.meta) else (lambda table: table)
    coded, stores = numbered_stores(shares)
    agg = weighted_sums(coded, cells.join(side(mids), "__mid"), ["__gid"], sums, store_keys=["__sid"])
    return agg.join(side(groups), "__gid").join(stores, "__sid").drop("__gid", "__sid")


def with_store_labels(profile: DataFrame) -> DataFrame:
    """STORE_CHAIN (chain label from the customer group / store name) and
    Region (from the store province)."""
    return profile.withColumn("STORE_CHAIN", store_chain("CUSTOMER_GROUP", "STORE_NAME")).withColumn(
        "Region", region("STORE_PROVINCE")
    )


def demographic_profile(shares: DataFrame, melted: DataFrame | Melted, language: DataFrame) -> DataFrame:
    """Demographic store profile: features outside Trends / Attitudes with a
    value, weighted by the shares and grouped by store, variable, description,
    language grouping, category and year; then chain and region labels.

    The language grouping, a function of the variable, is attached after
    aggregation.  A mapping row that repeats multiplies the sums, as joining
    it before the aggregation would."""
    keep = ~F.col("Category").isin(EXCLUDED_CATEGORIES)
    prof = profile(shares, melted, ["variable", "Description", "Category", "YEAR"], DEMO_SUMS, DEMO_DIMS, keep)
    lang = language.groupBy(F.col("Variable").alias("__lang_var"), "Language_Grouping").agg(
        F.count(F.lit(1)).alias("__times")
    )
    times = F.coalesce("__times", F.lit(1))
    prof = prof.join(lang, prof["variable"] == lang["__lang_var"], "left").withColumns(
        {c: F.col(c) * times for c in DEMO_SUMS}
    )
    return with_store_labels(prof.select(*DEMO_PROFILE_COLUMNS))


SV_PROFILE_COLUMNS = (
    ["CUSTOMER_GROUP", "STORE_NAME", "STORE_NUM", "CHANNEL", "SALES_GROUP", "BANNER", "STORE_STREET", "STORE_PROVINCE",
     "STORE_LATITUDE", "STORE_LONGITUDE", "variable", "Description", "Category", "YEAR", "val", "TOTAL_POPULATION"]
)


def social_profile(shares: DataFrame, melted_sv: DataFrame | Melted) -> DataFrame:
    """Social-value store profile: every feature with a value (NULL categories
    included), weighted by the shares; then chain and region labels."""
    prof = profile(shares, melted_sv, ["variable", "Description", "Category", "YEAR"], ["val", "TOTAL_POPULATION"])
    return with_store_labels(prof.select(*SV_PROFILE_COLUMNS))


def ratio_by_category(profile: DataFrame) -> DataFrame:
    """STORE_RATIO: the profile value over the total matching its category
    (households, population 15+, household population, else population)."""
    cat = F.col("Category")
    ratio = (
        F.when(cat.like("Households by%"), F.try_divide(F.col("val"), F.col("TOTAL_HOUSEHOLDS")))
        .when(
            cat.like("Household Population 15 Years or Over%"),
            F.try_divide(F.col("val"), F.col("TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER")),
        )
        .when(
            cat.like("Household Population%") & ~cat.like("%15 Years or Over%"),
            F.try_divide(F.col("val"), F.col("TOTAL_HOUSEHOLD_POPULATION")),
        )
        .otherwise(F.try_divide(F.col("val"), F.col("TOTAL_POPULATION")))
    )
    return profile.withColumn("STORE_RATIO", ratio)


def store_name_conflicts(shares: DataFrame) -> DataFrame:
    """Store numbers that appear under more than one name (per banner and
    province): a data-quality check."""
    return (
        shares.groupBy("STORE_NUM", "BANNER", "STORE_PROVINCE")
        .agg(F.countDistinct("STORE_NAME").alias("count"))
        .filter(F.col("count") > 1)
    )
