"""Queries: feature union, selection, tagging, legs, pivot / melt, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from .. import schemas
from ..functions.codes import year_from_code
from ..functions.text import clean_description
from ..operators import features as feat
from ..queries import register
from ..sources import fixtures as fx
from ..sources import tables
from . import inputs

RAW = ["CODE", "var_code", "var_value", "Description", "Category"]
SELECTED = RAW + schemas.DIM_COLUMNS + ["WHOLE_YEAR"]
TAGGED = ["CODE", "variable", "value", "Description", "Category"] + schemas.DIM_COLUMNS + ["WHOLE_YEAR", "YEAR"]
MELTED = schemas.MELTED_COLUMNS + ["YEAR"]
SV_MELTED = ["variable", "POSTALCODE", "Description", "Category", "val", "TOTAL_POPULATION", "YEAR"]

# Variables of the fixture's legs (pivot columns) and of the social-value years.
LEG_VARIABLES = sorted(
    [f"{prefix}{sfx}" for prefix in feat.LEG_PREFIXES.values()
     for (sfx, _d, _c, add, _l, _t) in fx.FEATURE_VARIABLES if add == 1]
    + [code for code, _d, _l in fx.NEWCOMER_VARIABLES]
)
SV_VARIABLES = sorted(code for code, _d, _c in fx.SOCIAL_VALUE_VARIABLES)


def _leg(name: str):
    return next(leg for leg in feat.demographic_legs() if leg.name == name)


@register("feature_union", RAW, "SELECT * FROM feat_union")
def feature_union(spark, sf):
    """SRC-4 / SET-1: SQL UNION of the six raw feature tables."""
    return inputs.features_union(spark, sf)


@register("feature_select", SELECTED, "SELECT * FROM feat_sel")
def feature_select(spark, sf):
    """F-12 / JOIN-2 / JOIN-3 / PRJ-6: suffix join to the variable dimension
    and profile-variable selection ((IN AND flag) OR year)."""
    return inputs.features_selected(spark, sf)


@register("features_tagged", TAGGED, "SELECT * FROM feat_tag")
def features_tagged(spark, sf):
    """FN-4 / FN-7 / PRJ-3: year tag from the prefix, renames, cleaned text."""
    return inputs.features_tagged(spark, sf)


@register(
    "year_from_code",
    ["variable", "YEAR"],
    """SELECT DISTINCT var_code AS variable, CASE substr(var_code, 1, 3) WHEN 'EHY' THEN 2018 WHEN 'ECY' THEN 2023
  WHEN 'P3Y' THEN 2026 WHEN 'P5Y' THEN 2028 WHEN 'P0Y' THEN 2033 END AS YEAR FROM feat_union""",
)
def year_from_code_q(spark, sf):
    """FN-4: year of every distinct variable code (NULL for unknown prefixes)."""
    u = inputs.features_union(spark, sf)
    return u.select(F.col("var_code").alias("variable"), year_from_code("var_code").alias("YEAR")).distinct()


@register(
    "clean_description",
    ["Description", "Description_clean"],
    f"SELECT DISTINCT Description, {O.CLEAN_SQL} AS Description_clean FROM feat_union",
)
def clean_description_q(spark, sf):
    """FN-7: description cleaner on every distinct description."""
    u = inputs.features_union(spark, sf)
    return u.select("Description", clean_description("Description").alias("Description_clean")).distinct()


@register("features_2023", TAGGED, "SELECT * FROM leg23")
def features_2023(spark, sf):
    """F-9: the current-year leg (2023, 2024 or whole-table YEAR)."""
    return feat.leg_rows(inputs.features_tagged(spark, sf), _leg("2023"))


@register(
    "features_projection",
    TAGGED,
    "SELECT * FROM leg26 UNION ALL SELECT * FROM leg28 UNION ALL SELECT * FROM leg33",
)
def features_projection(spark, sf):
    """F-10: the 2026, 2028 and 2033 projection legs."""
    t = inputs.features_tagged(spark, sf)
    # The three legs are disjoint (one YEAR each): their stack is one filter.
    legs = [_leg(n) for n in ("2026", "2028", "2033")]
    return t.filter(legs[0].filter | legs[1].filter | legs[2].filter)


@register(
    "features_newcomer_only",
    TAGGED,
    "SELECT * FROM feat_tag WHERE YEAR = 2024 OR WHOLE_YEAR IS NOT NULL",
)
def features_newcomer_only(spark, sf):
    """F-11: newcomer rows (YEAR 2024 or a whole-table YEAR)."""
    t = inputs.features_tagged(spark, sf)
    return t.filter((F.col("YEAR") == 2024) | F.col("WHOLE_YEAR").isNotNull())


LEGS_SQL = {"2023": "leg23", "2026": "leg26", "2028": "leg28", "2033": "leg33"}


def _all_legs_sql(select: str) -> str:
    """``select`` (with {leg} and {name}) over the four legs, stacked."""
    return " UNION ALL ".join(select.format(leg=leg, name=name) for name, leg in LEGS_SQL.items())


def _pivot_sql(rows_sql: str, key: str, variables: list[str]) -> str:
    cols = ", ".join(f"max(CASE WHEN variable = '{v}' THEN value END) AS \"{v}\"" for v in variables)
    return f"SELECT CODE AS POSTALCODE, {key}, {cols} FROM ({rows_sql}) r GROUP BY CODE, {key}"


@register(
    "pivot_features",
    ["POSTALCODE", "LEG"] + LEG_VARIABLES,
    _pivot_sql(_all_legs_sql("SELECT CODE, variable, value, '{name}' AS LEG FROM {leg}"), "LEG", LEG_VARIABLES),
)
def pivot_features(spark, sf):
    """RSH-1 / AGG-2: all four legs long -> wide, a row per postal code and leg
    and one column per variable."""
    rows = feat.by_leg(inputs.features_tagged(spark, sf), feat.demographic_legs())
    return feat.pivot_wide(rows, [F.col("CODE").alias("POSTALCODE"), "LEG"])


SV_ROWS = "SELECT CODE, var_code AS variable, var_value AS value, YEAR FROM features_sv"


@register("sv_pivot", ["POSTALCODE", "YEAR"] + SV_VARIABLES, _pivot_sql(SV_ROWS, "YEAR", SV_VARIABLES))
def sv_pivot(spark, sf):
    """RSH-1 / AGG-2: both years of social values long -> wide, a row per
    postal code and year."""
    years = [df.withColumn("YEAR", F.lit(year)) for year, df in inputs.social_values_by_year(spark, sf).items()]
    return feat.pivot_wide(tables.stack_by_position(*years), [F.col("CODE").alias("POSTALCODE"), "YEAR"])


@register(
    "sv_long",
    ["CODE", "variable", "value", "Description", "Category", "YEAR"],
    "SELECT CODE, var_code AS variable, var_value AS value, Description, Category, YEAR FROM features_sv",
)
def sv_long(spark, sf):
    """SRC-5 / PRJ-3: social-value tables with VARIABLES / VALUES renamed."""
    return tables.load_social_values(fx.features_social(spark, sf))


MELT_SQL = " UNION ALL ".join(f"SELECT *, '20{yy}' AS LEG FROM melt{yy}" for yy in (23, 26, 28, 33))


@register("melt_features", MELTED + ["LEG"], MELT_SQL)
def melt_features(spark, sf):
    """RSH-2 / PRJ-7 / JOIN-4 / JOIN-5: every leg melted (dense), with variable
    metadata, per-postal totals and the leg's name on every row."""
    return feat.melt_demographics_keyed(inputs.features_tagged(spark, sf)).table(leg="LEG")


TOTALS_SQL = " UNION ALL ".join(
    f"SELECT *, '{name}' AS LEG FROM ({O.totals_sql(LEGS_SQL[name], prefix, O.DEMO_TOTALS_SQL)}) t"
    for name, prefix in feat.LEG_PREFIXES.items()
)


@register("postal_totals", ["POSTALCODE", "LEG"] + list(feat.DEMO_TOTALS), TOTALS_SQL)
def postal_totals(spark, sf):
    """RSH-3: population totals of each postal code and leg as columns."""
    return feat.totals_by_leg(inputs.features_tagged(spark, sf), feat.demographic_legs(), feat.DEMO_TOTALS)


@register(
    "variable_metadata",
    ["LEG"] + feat.METADATA_COLUMNS,
    _all_legs_sql(
        "SELECT DISTINCT '{name}' AS LEG, variable, Description, Category, Hierarchy_Description, MEDIAN_AVERAGE,"
        " ADD_TO_PROFILE, LEAF_NODE_FLAG, TOTAL_FLAG FROM {leg}"
    ),
)
def variable_metadata(spark, sf):
    """AGG-7: distinct variable metadata of every leg."""
    return feat.variable_metadata(feat.by_leg(inputs.features_tagged(spark, sf), feat.demographic_legs()), ("LEG",))


@register("features_stacked", MELTED, "SELECT * FROM melted")
def features_stacked(spark, sf):
    """RSH-5 / SET-2 / FN-5: the four melted legs stacked with their YEAR
    (newcomer variables 2024 in the current-year leg)."""
    return inputs.features_melted(spark, sf)


@register(
    "feature_search",
    MELTED,
    "SELECT * FROM melted WHERE contains(Category, '23Q2 to 24Q1 - Temporary Resident - Region of Citizenship')",
)
def feature_search(spark, sf):
    """F-16: text search on Category in the melted table."""
    return inputs.features_melted(spark, sf).filter(F.col("Category").contains(fx.NEWCOMER_CATEGORY))


@register("feature_description_search", MELTED, "SELECT * FROM melted WHERE Description = 'Born in Cote d Ivoire'")
def feature_description_search(spark, sf):
    """F-16: equality on the (cleaned) Description in the melted table."""
    return inputs.features_melted(spark, sf).filter(F.col("Description") == "Born in Cote d Ivoire")


@register("sv_features_stacked", SV_MELTED, "SELECT * FROM sv_melted")
def sv_features_stacked(spark, sf):
    """RSH-2 / RSH-5: social values melted per year and stacked."""
    return inputs.social_values_melted(spark, sf)
