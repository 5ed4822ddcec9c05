"""Queries: store profiles, level benchmarks, store values, medians, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions.codes import region
from ..functions.text import store_chain
from ..operators import levels as lv
from ..operators import profiles as prof
from ..queries import register
from .layout import materialize
from . import inputs

PROFILE = prof.DEMO_PROFILE_COLUMNS + ["STORE_CHAIN", "Region"]
ROW_KEYS = ["STORE_NUM", "STORE_NAME", "CUSTOMER_GROUP", "variable", "Description", "Language_Grouping", "Category", "YEAR"]
SV_ROW_KEYS = ["STORE_NUM", "STORE_NAME", "CUSTOMER_GROUP", "variable", "Description", "Category", "YEAR"]


@register("profile_demo", PROFILE, "SELECT * FROM prof_demo")
def profile_demo(spark, sf):
    """AGG-3 / AGG-5 / JOIN-6 / JOIN-7 / F-7 / FN-3 / FN-8: demographic store
    profile (weighted sums by store, variable and year) with chain and region."""
    return inputs.demographic_profile(spark, sf)


LEVEL_KEYS = {
    "BANNER_VALUE": "banner",
    "CHANNEL_RE_VALUE": "region_channel",
    "REGION_VALUE": "region",
    "CHANNEL_VALUE": "channel",
}


def _level_query(name: str, keys: list[str]):
    cols = ROW_KEYS + [k for k in keys if k not in ROW_KEYS] + [name]

    @register(f"level_{LEVEL_KEYS[name]}", cols, "SELECT * FROM prof_lev")
    def q(spark, sf):
        return lv.level_values(inputs.demographic_profile(spark, sf), [(name, keys)])

    q.__doc__ = f"WIN-7..10: {name} = sum(val) / sum(TOTAL_POPULATION) over {', '.join(keys)}."
    return q


for _name, _keys in lv.LEVEL_VALUES:
    _level_query(_name, _keys)


def _percent_query(name: str, value: str, keys: list[str]):
    cols = ROW_KEYS + [k for k in keys if k not in ROW_KEYS] + ["LEAF_NODE_FLAG", value, name]
    @register(f"level_{LEVEL_KEYS[value]}_pct", cols, "SELECT * FROM prof_pct")
    def q(spark, sf):
        with_values = materialize(lv.level_values(inputs.demographic_profile(spark, sf)))
        return lv.level_percents(with_values, [(name, value, keys)])

    q.__doc__ = f"WIN-11..14: {name} = {value} over the leaf {value} sum over {', '.join(keys)}."
    return q


for _name, _value, _keys in lv.LEVEL_PERCENTS:
    _percent_query(_name, _value, _keys)


@register("profile_final", schemas.PROFILE_FINAL_COLUMNS, "SELECT * FROM prof_final")
def profile_final(spark, sf):
    """PRJ-1: the published 28-column demographic store table."""
    return lv.demographic_store_table(inputs.demographic_profile(spark, sf))


@register(
    "profile_store_value",
    ["STORE_NUM", "STORE_NAME", "Category", "variable", "Description", "YEAR", "val", "TOTAL_CATEGORY", "STORE_VALUE"],
    "SELECT * FROM prof_final",
)
def profile_store_value(spark, sf):
    """JOIN-8 / FN-9 / PRJ-4: category total join and STORE_VALUE."""
    return lv.demographic_store_table(inputs.demographic_profile(spark, sf))


@register(
    "category_totals",
    ["STORE_NAME", "STORE_NUM", "Category", "YEAR", "TOTAL_CATEGORY"],
    "SELECT * FROM prof_total",
)
def category_totals(spark, sf):
    """F-14: category totals (TOTAL_FLAG = 1) per store and year."""
    bench = lv.demographic_benchmarks(inputs.demographic_profile(spark, sf))
    return lv.category_totals(bench)


@register(
    "profile_ratio_by_category",
    ["STORE_NUM", "STORE_NAME", "variable", "Description", "Category", "YEAR", "val", "STORE_RATIO"],
    """SELECT *, CASE WHEN Category LIKE 'Households by%' THEN val / nullif(TOTAL_HOUSEHOLDS, 0)
  WHEN Category LIKE 'Household Population 15 Years or Over%' THEN val / nullif(TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER, 0)
  WHEN Category LIKE 'Household Population%' AND Category NOT LIKE '%15 Years or Over%' THEN val / nullif(TOTAL_HOUSEHOLD_POPULATION, 0)
  ELSE val / nullif(TOTAL_POPULATION, 0) END AS STORE_RATIO FROM prof_demo""",
)
def profile_ratio_by_category(spark, sf):
    """AGG-9: profile value over the total that matches its category."""
    return prof.ratio_by_category(inputs.demographic_profile(spark, sf))


# The profile's categories under names that each ratio rule knows.
RATIO_NAMES = {
    "Income": "Households by Income",
    "Basics": "Household Population 15 Years or Over by Basics",
    "Birthplace": "Household Population by Birthplace",
}
RATIO_CASE = "CASE Category " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RATIO_NAMES.items()) + " ELSE Category END"


@register(
    "profile_ratio_categories",
    ["STORE_NUM", "STORE_NAME", "variable", "Description", "Category", "YEAR", "val", "STORE_RATIO"],
    f"""SELECT STORE_NUM, STORE_NAME, variable, Description, Category, YEAR, val, CASE split_part(Category, ' by ', 1)
  WHEN 'Households' THEN val / nullif(TOTAL_HOUSEHOLDS, 0)
  WHEN 'Household Population 15 Years or Over' THEN val / nullif(TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER, 0)
  WHEN 'Household Population' THEN val / nullif(TOTAL_HOUSEHOLD_POPULATION, 0)
  ELSE val / nullif(TOTAL_POPULATION, 0) END AS STORE_RATIO
FROM (SELECT * REPLACE ({RATIO_CASE} AS Category) FROM prof_demo) p""",
)
def profile_ratio_categories(spark, sf):
    """AGG-9: the ratio by category where every rule has rows."""
    named = inputs.demographic_profile(spark, sf).withColumn("Category", F.expr(RATIO_CASE))
    return prof.ratio_by_category(named)


SV_PROFILE = prof.SV_PROFILE_COLUMNS + ["STORE_CHAIN", "Region"]


@register("profile_sv", SV_PROFILE, "SELECT * FROM prof_sv")
def profile_sv(spark, sf):
    """AGG-4 / F-8: social-value store profile (NULL categories kept)."""
    return inputs.social_profile(spark, sf)


SV_LEVELS = SV_ROW_KEYS + ["val", "TOTAL_POPULATION"] + [n for n, _ in lv.LEVEL_VALUES]


@register("sv_levels", SV_LEVELS, "SELECT * FROM sv_lev")
def sv_levels(spark, sf):
    """WIN-7..10 on social values: banner, region-channel, region, channel values."""
    return lv.social_benchmarks(inputs.social_profile(spark, sf))


@register("sv_basics_total", ["STORE_NAME", "STORE_NUM", "TOTAL_CATEGORY"], "SELECT * FROM sv_basics")
def sv_basics_total(spark, sf):
    """F-15: Basics rows of the social-value profile as totals."""
    return lv.basics_totals(lv.social_benchmarks(inputs.social_profile(spark, sf)))


SV_FINAL = SV_PROFILE + ["LONGITUDE", "LATITUDE"] + [n for n, _ in lv.LEVEL_VALUES] + ["TOTAL_CATEGORY", "STORE_VALUE"]


@register("sv_store_value", SV_FINAL, "SELECT * FROM sv_final")
def sv_store_value(spark, sf):
    """JOIN-8b / FN-10: Basics total joined on store (no year key, so rows
    repeat per Basics row) and STORE_VALUE = val / TOTAL_CATEGORY."""
    return lv.social_store_table(inputs.social_profile(spark, sf))


def _median_query(level: str, value: str):
    col = f"Median_{value}"

    @register(
        f"median_{level.lower()}",
        ["Description", level, col],
        f"SELECT Description, {level}, quantile_disc({value}, 0.5) AS {col} FROM sv_lev GROUP BY Description, {level}",
    )
    def q(spark, sf):
        return lv.median_by(lv.social_benchmarks(inputs.social_profile(spark, sf)), level, value)

    q.__doc__ = f"AGG-8 / UDF-3: percentile_approx median of {value} per (Description, {level})."
    return q


MEDIAN_LEVELS = [("BANNER", "BANNER_VALUE"), ("Region", "REGION_VALUE"), ("CHANNEL", "CHANNEL_VALUE")]
for _level, _value in MEDIAN_LEVELS:
    _median_query(_level, _value)


@register(
    "median_by_level",
    ["LEVEL", "LEVEL_VALUE", "Description", "MEDIAN"],
    " UNION ALL ".join(
        f"SELECT '{lvl}' AS LEVEL, {lvl} AS LEVEL_VALUE, Description, quantile_disc({val}, 0.5) AS MEDIAN"
        f" FROM sv_lev GROUP BY Description, {lvl}"
        for lvl, val in MEDIAN_LEVELS
    ),
)
def median_by_level(spark, sf):
    """AGG-8: the three level medians in one long table (LEVEL names the level
    column, LEVEL_VALUE its value)."""
    bench = lv.social_benchmarks(inputs.social_profile(spark, sf))
    return lv.medians_by(bench, MEDIAN_LEVELS)


@register(
    "median_exact",
    ["LEVEL", "LEVEL_VALUE", "Description", "MEDIAN"],
    " UNION ALL ".join(
        f"SELECT '{lvl}' AS LEVEL, {lvl} AS LEVEL_VALUE, Description, median(round({val}, 9)) AS MEDIAN"
        f" FROM sv_lev GROUP BY Description, {lvl}"
        for lvl, val in MEDIAN_LEVELS
    ),
)
def median_exact(spark, sf):
    """AGG-8, exact form: interpolated medians of the three levels, selected
    by rank (values to nine decimals, as the engines add in another order)."""
    bench = lv.social_benchmarks(inputs.social_profile(spark, sf))
    return lv.exact_medians(lv.level_entries(bench, MEDIAN_LEVELS, 9), ["LEVEL", "LEVEL_VALUE", "Description"], "v", "MEDIAN")


@register(
    "store_name_conflicts",
    ["STORE_NUM", "BANNER", "STORE_PROVINCE", "count"],
    """SELECT STORE_NUM, BANNER, STORE_PROVINCE, COUNT(DISTINCT STORE_NAME) AS count FROM att_half
GROUP BY STORE_NUM, BANNER, STORE_PROVINCE HAVING COUNT(DISTINCT STORE_NAME) > 1""",
)
def store_name_conflicts(spark, sf):
    """AGG-6 / F-17: store numbers with more than one store name."""
    return prof.store_name_conflicts(inputs.half_pct(spark, sf))


@register(
    "store_name_conflicts_renamed",
    ["STORE_NUM", "BANNER", "STORE_PROVINCE", "count"],
    """SELECT STORE_NUM, BANNER, STORE_PROVINCE, COUNT(DISTINCT STORE_NAME) AS count FROM (SELECT * FROM stores UNION ALL
  SELECT * REPLACE (CASE WHEN STORE_NUM % 5 = 0 THEN concat('NEW ', STORE_NAME) ELSE STORE_NAME END AS STORE_NAME) FROM stores) s
GROUP BY STORE_NUM, BANNER, STORE_PROVINCE HAVING COUNT(DISTINCT STORE_NAME) > 1""",
)
def store_name_conflicts_renamed(spark, sf):
    """AGG-6 / F-17: the same check over two deliveries of the stores, the
    later of which names every fifth store anew (repeated rows count once)."""
    now = inputs.stores(spark, sf)
    renamed = F.when(F.col("STORE_NUM") % 5 == 0, F.concat(F.lit("NEW "), F.col("STORE_NAME")))
    later = now.withColumn("STORE_NAME", F.coalesce(renamed, F.col("STORE_NAME")))
    return prof.store_name_conflicts(now.unionByName(later))


@register("profile_description_search", SV_PROFILE, "SELECT * FROM prof_sv WHERE Description = 'Importance of Price'")
def profile_description_search(spark, sf):
    """F-16: equality on Description in the social-value profile."""
    return inputs.social_profile(spark, sf).filter(F.col("Description") == "Importance of Price")


REGION_SQL = (
    "CASE WHEN STORE_PROVINCE = 'ON' THEN 'ONTARIO' WHEN STORE_PROVINCE = 'QC' THEN 'QUEBEC'"
    " WHEN STORE_PROVINCE IN ('AB', 'BC', 'MB', 'SK', 'YT', 'NT') THEN 'WEST'"
    " WHEN STORE_PROVINCE IN ('NS', 'NB', 'NL', 'PE') THEN 'EAST' ELSE STORE_PROVINCE END"
)


@register("region_map", ["STORE_PROVINCE", "Region"], f"SELECT DISTINCT STORE_PROVINCE, {REGION_SQL} AS Region FROM stores")
def region_map(spark, sf):
    """FN-3: region of each store province."""
    return inputs.stores(spark, sf).select("STORE_PROVINCE", region("STORE_PROVINCE").alias("Region")).distinct()


@register(
    "store_chain",
    ["CUSTOMER_GROUP", "STORE_NAME", "STORE_CHAIN"],
    """SELECT DISTINCT CUSTOMER_GROUP, STORE_NAME, CASE WHEN CUSTOMER_GROUP IN ('AOL_AO LOCAL', 'AON_AO NATL RETAIL')
  THEN regexp_replace(STORE_NAME, '#\\d+\\s*[A-Z]*\\s*[A-Z]*\\s*', '', 'g') ELSE CUSTOMER_GROUP END AS STORE_CHAIN FROM stores""",
)
def store_chain_q(spark, sf):
    """FN-8: chain label of each store."""
    s = inputs.stores(spark, sf)
    return s.select("CUSTOMER_GROUP", "STORE_NAME", store_chain("CUSTOMER_GROUP", "STORE_NAME").alias("STORE_CHAIN")).distinct()


@register(
    "attraction_population",
    schemas.SHARE_COLUMNS + ["TOTAL_POPULATION"],
    """SELECT a.*, t.TOTAL_POPULATION FROM att_half a LEFT JOIN
  (SELECT CODE AS POSTALCODE, max(CASE WHEN variable = 'ECYBASPOP' THEN value END) AS TOTAL_POPULATION
   FROM leg23 GROUP BY CODE) t ON a.POSTALCODE = t.POSTALCODE""",
)
def attraction_population(spark, sf):
    """JOIN-10: shares with the postal code's total population (one total per
    postal code, from the current-year leg)."""
    from ..operators import features as feat

    leg = next(x for x in feat.demographic_legs() if x.name == "2023")
    totals = feat.postal_totals(
        feat.leg_rows(inputs.features_tagged(spark, sf), leg), {"TOTAL_POPULATION": "BASPOP"}, leg.total_prefix
    )
    return inputs.half_pct(spark, sf).join(totals, "POSTALCODE", "left")
