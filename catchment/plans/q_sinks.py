"""Queries: sinks (stage round trip, positional publish, padding, CTAS union)
and the multi-source store union."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from .. import schemas
from ..operators import attraction as att
from ..operators import features as feat
from ..operators import levels as lv
from ..operators import profiles as prof
from ..queries import register
from ..sinks import tables as sinks
from ..sources import fixtures as fx
from ..sources.store_sources import Field, StoreSource, checked_union, union_sources, write_checked
from . import inputs


def _scoped(name: str, sf: str) -> str:
    """Stage / table name unique to the data folder, so results built for
    different folders never share files."""
    return f"{name}_{hashlib.sha1(sf.encode()).hexdigest()[:10]}"


@register("stage_roundtrip", schemas.SHARE_COLUMNS, "SELECT * FROM att_half")
def stage_roundtrip(spark, sf):
    """SNK-1 / SNK-5 / SRC-6: write the 0.5% share table as a stage table
    (rows sorted by POSTALCODE inside each file), copy it unchanged to a
    published name and read the copy back."""
    stage, published = _scoped("attraction_half_pct", sf), _scoped("attraction_half_pct_published", sf)
    sinks.write_stage(inputs.half_pct(spark, sf), stage, sort_within=["POSTALCODE"])
    return sinks.copy_table(spark, stage, published)


PUBLISHED = schemas.PROFILE_FINAL_COLUMNS + list(sinks.PUBLISH_PADS)
PAD_SQL = "SELECT *, CAST(0.0 AS DOUBLE) AS REVENUE_CY, '' AS OUTLIER FROM prof_final"


@register("publish_pad", PUBLISHED, PAD_SQL)
def publish_pad(spark, sf):
    """SNK-4 / PRJ-5: the store table padded with REVENUE_CY = 0.0 and
    OUTLIER = '' for the published layout."""
    return sinks.pad_columns(lv.demographic_store_table(inputs.demographic_profile(spark, sf)), sinks.PUBLISH_PADS)


PUBLISH_TABLE = "catchment_store_profiles"


@register("publish_positional", PUBLISHED, PAD_SQL)
def publish_positional(spark, sf):
    """SNK-2: publish into an existing table whose columns match by position;
    the rows arrive with their columns in another order and are selected by
    name in the target order first."""
    padded = sinks.pad_columns(lv.demographic_store_table(inputs.demographic_profile(spark, sf)), sinks.PUBLISH_PADS)
    target = padded.select(*PUBLISHED)
    table = _scoped(PUBLISH_TABLE, sf)
    sinks.create_table(spark.createDataFrame([], target.schema), table)
    sinks.publish(padded.select(*reversed(PUBLISHED)), table)
    return spark.table(table)


MELTED = schemas.MELTED_COLUMNS + ["YEAR"]


@register(
    "ctas_union",
    MELTED,
    f"SELECT * FROM melted UNION SELECT * FROM melted WHERE Category = '{fx.NEWCOMER_CATEGORY}'",
)
def ctas_union(spark, sf):
    """SNK-3 / SET-1: CREATE TABLE AS (melted table UNION newcomer table).  The
    four legs are melted and written once; the newcomer table is its rows of
    that category, all of which the distinct union has twice."""
    stage = _scoped("melted_all", sf)
    sinks.write_stage(inputs.features_melted(spark, sf), stage)
    newcomers = sinks.read_stage(spark, stage, F.col("Category") == fx.NEWCOMER_CATEGORY)
    return sinks.combine_tables(sinks.read_stage(spark, stage), newcomers, _scoped("melted_combined", sf))


STORE_SOURCE_COLUMNS = [
    "STORE_NUM", "STORE_NAME", "BANNER", "STREET", "POSTAL_CODE", "PROVINCE", "STORE_CHAIN", "LONGITUDE", "LATITUDE",
    "REVENUE_CY", "CHANNEL", "SALES_GROUP", "SOURCE",
]


@register(
    "store_sources_union",
    STORE_SOURCE_COLUMNS,
    """SELECT STORE_NUM, STORE_NAME, BANNER, STREET, POSTAL_CODE, PROVINCE, STORE_CHAIN, LONGITUDE, LATITUDE, REVENUE_CY,
  CHANNEL, CASE WHEN CHANNEL = 'DRUG' THEN NULL ELSE SALES_GROUP END AS SALES_GROUP,
  CASE CHANNEL WHEN 'GROCERY' THEN 'POS' WHEN 'MASS' THEN 'SHIPMENT' ELSE 'CLUB' END AS SOURCE
FROM stores_raw WHERE CHANNEL IN ('GROCERY', 'MASS', 'DRUG')""",
)
def store_sources_union(spark, sf):
    """SRC-7: three store sources (point of sale, shipments, club) with their
    own column names and row filters, renamed and stacked by name."""
    raw = fx.stores_raw(spark, sf)
    shipment = raw.withColumnsRenamed({"STORE_NUM": "SHIP_TO_NUM", "STORE_NAME": "SHIP_TO_NAME"})
    club = raw.drop("SALES_GROUP")
    return union_sources(
        [
            StoreSource(raw, "POS", predicate=F.col("CHANNEL") == "GROCERY"),
            StoreSource(shipment, "SHIPMENT", {"SHIP_TO_NUM": "STORE_NUM", "SHIP_TO_NAME": "STORE_NAME"},
                        F.col("CHANNEL") == "MASS"),
            StoreSource(club, "CLUB", predicate=F.col("CHANNEL") == "DRUG"),
        ]
    )


#: What a store row must be before it is used (bounds of places on Earth).
STORE_CONTRACT = {
    "STORE_NUM": Field("bigint", required=True),
    "STORE_NAME": Field("string"),
    "BANNER": Field("string", required=True),
    "STORE_CHAIN": Field("string", required=True),
    "LONGITUDE": Field("double", required=True, low=-180.0, high=180.0),
    "LATITUDE": Field("double", required=True, low=-90.0, high=90.0),
    "REVENUE_CY": Field("double", required=True),
}


def _messy_sources(spark, sf):
    """The three store sources with faults of their own: point-of-sale rows
    without a banner, shipment longitudes as text that is no number, and club
    latitudes in tenths of a degree."""
    raw, s = fx.stores_raw(spark, sf), F.col("STORE_NUM")
    pos = raw.filter("CHANNEL = 'GROCERY'").withColumn("BANNER", F.when(s % 9 != 0, F.col("BANNER")))
    text = F.when(s % 7 == 0, F.lit("n/a")).otherwise(F.col("LONGITUDE").cast("string"))
    ship = raw.filter("CHANNEL = 'MASS'").withColumn("LONGITUDE", text).withColumnRenamed("STORE_NUM", "SHIP_TO_NUM")
    tenths = F.when(s % 4 == 0, F.col("LATITUDE") * 10).otherwise(F.col("LATITUDE"))
    club = raw.filter("CHANNEL = 'DRUG'").withColumn("LATITUDE", tenths)
    return [StoreSource(pos, "POS"), StoreSource(ship, "SHIPMENT", {"SHIP_TO_NUM": "STORE_NUM"}), StoreSource(club, "CLUB")]


MESSY_SQL = """SELECT STORE_NUM, STORE_NAME, CASE CHANNEL WHEN 'GROCERY' THEN 'POS' WHEN 'MASS' THEN 'SHIPMENT' ELSE 'CLUB' END AS SOURCE,
  concat_ws('; ', CASE WHEN BANNER IS NULL OR (CHANNEL = 'GROCERY' AND STORE_NUM % 9 = 0) THEN 'BANNER is missing' END,
    CASE WHEN STORE_CHAIN IS NULL THEN 'STORE_CHAIN is missing' END,
    CASE WHEN CHANNEL = 'MASS' AND STORE_NUM % 7 = 0 THEN 'LONGITUDE is not a double' END,
    CASE WHEN CHANNEL = 'DRUG' AND STORE_NUM % 4 = 0 AND LATITUDE * 10 > 90 THEN 'LATITUDE is out of range' END,
    CASE WHEN REVENUE_CY IS NULL THEN 'REVENUE_CY is missing' END) AS REASONS
FROM stores_raw"""


@register("store_sources_rejects", ["STORE_NUM", "STORE_NAME", "SOURCE", "REASONS"],
          f"SELECT * FROM ({MESSY_SQL}) m WHERE REASONS <> ''")
def store_sources_rejects(spark, sf):
    """SRC-7: the rows of three store sources that break the store contract,
    with all that is wrong with each."""
    checked = checked_union(_messy_sources(spark, sf), STORE_CONTRACT)
    return write_checked(checked, _scoped("stores_checked_rejects", sf))[1]


@register("store_sources_accepted", ["STORE_NUM", "STORE_NAME", "SOURCE"],
          f"SELECT * FROM ({MESSY_SQL}) m WHERE REASONS = ''")
def store_sources_accepted(spark, sf):
    """SRC-7: the rows of three store sources that keep the store contract."""
    checked = checked_union(_messy_sources(spark, sf), STORE_CONTRACT)
    return write_checked(checked, _scoped("stores_checked", sf))[0]


@register("stage_year_overwrite", MELTED, """SELECT * REPLACE (CASE WHEN YEAR = 2026 THEN val * 2 ELSE val END AS val)
FROM melted""")
def stage_year_overwrite(spark, sf):
    """SNK-1 / SRC-6: the melted table as a stage partitioned by YEAR, of which
    one year is then replaced by a revision (values doubled); the files of the
    other years stay as they are."""
    stage, legs = _scoped("melted_by_year", sf), feat.demographic_legs()
    sinks.write_partitioned_stage(inputs.features_melted(spark, sf), stage, ["YEAR"])
    revised = feat.melt_demographics(inputs.features_tagged(spark, sf), [leg for leg in legs if leg.name == "2026"])
    sinks.replace_partitions(revised.withColumn("val", F.col("val") * 2), stage, ["YEAR"])
    return sinks.read_stage(spark, stage)


SOCIAL_PUBLISHED = (
    prof.SV_PROFILE_COLUMNS + ["STORE_CHAIN", "Region", "LONGITUDE", "LATITUDE"]
    + [name for name, _ in lv.LEVEL_VALUES] + ["TOTAL_CATEGORY", "STORE_VALUE"]
)


@register("publish_social", SOCIAL_PUBLISHED, "SELECT * FROM sv_final")
def publish_social(spark, sf):
    """SNK-2 / SNK-5: the social-value store table published into an existing
    table by position, after its row and key checks."""
    rows = lv.social_store_table(inputs.social_profile(spark, sf)).select(*SOCIAL_PUBLISHED)
    table = _scoped("catchment_social_store_values", sf)
    sinks.create_table(spark.createDataFrame([], rows.schema), table)
    sinks.publish_checked(rows, table, ["STORE_NUM", "variable", "YEAR"], (["STORE_NUM", "BANNER"], "STORE_NAME"))
    return spark.table(table)


DIMENSION = ["variable", "Category", *schemas.DIM_COLUMNS, "WHOLE_YEAR"]


@register("publish_dimension", DIMENSION, f"SELECT DISTINCT {', '.join(DIMENSION)} FROM feat_tag")
def publish_dimension(spark, sf):
    """SNK-2 / SNK-5: the dimension of the variables that the feature tables
    hold, published by position after its checks."""
    rows = inputs.features_tagged(spark, sf).select(*DIMENSION).distinct()
    table = _scoped("catchment_dim_variables", sf)
    sinks.create_table(spark.createDataFrame([], rows.schema), table)
    sinks.publish_checked(rows, table, ["variable"], (["variable"], "Hierarchy_Description"))
    return spark.table(table)


@register("attraction_half_pct_staged", schemas.SHARE_COLUMNS, "SELECT * FROM att_half")
def attraction_half_pct_staged(spark, sf):
    """SRC-6 / SNK-1: the source's staged flow.  The full attraction table is
    written as a stage bucketed and sorted by POSTALCODE, read back with the
    cut predicate, and renormalised per postal code: the bucket layout
    satisfies the per-postal window, so the re-read needs no shuffle."""
    table = sinks.write_bucketed_stage(
        inputs.full_attraction(spark, sf), _scoped("store_postal_attraction", sf), ["POSTALCODE"]
    )
    cut = F.col("Attraction") > F.lit(att.HALF_PERCENT) * F.col("TOTAL_POSTALCODE_ATTRACTION")
    return att.renormalise(sinks.read_bucketed_stage(spark, table, cut)).select(*schemas.SHARE_COLUMNS)


@register(
    "postal_lookup_staged",
    ["STORE_NUM", "POSTALCODE", "Attraction", "TOTAL_POSTALCODE_ATTRACTION", "CUMULATIVE_PERCENT_ATTRACTION"],
    "SELECT * FROM att_full WHERE POSTALCODE = 'P0000003'",
)
def postal_lookup_staged(spark, sf):
    """F-6 on a stage table: the equality filter is pushed to the Parquet scan,
    where the POSTALCODE-sorted files let row groups be skipped."""
    stage = _scoped("store_postal_attraction_lookup", sf)
    sinks.write_stage(inputs.full_attraction(spark, sf), stage, sort_within=["POSTALCODE"])
    return sinks.read_stage(spark, stage, F.col("POSTALCODE") == "P0000003")
