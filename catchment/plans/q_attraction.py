"""Queries: sources, pair join, distance, attraction, totals and share cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from .. import schemas
from ..functions.geo import gravity
from ..operators import adjacency as adjm
from ..operators import attraction as att
from ..queries import register
from ..sources import fixtures as fx
from ..sources import tables
from . import inputs

SHARES = schemas.SHARE_COLUMNS
FULL = schemas.ATTRACTION_COLUMNS
STORES = [
    "STORE_NUM", "STORE_NAME", "BANNER", "STORE_STREET", "POSTAL_CODE", "STORE_PROVINCE", "CUSTOMER_GROUP",
    "STORE_LONGITUDE", "STORE_LATITUDE", "REVENUE_CY", "CHANNEL", "SALES_GROUP",
]

# Postal code used by the point-lookup query (present at every scale factor).
LOOKUP_POSTALCODE = "P0000003"


@register("stores_clean", STORES, "SELECT * FROM stores")
def stores_clean(spark, sf):
    """SRC-2 / F-1 / PRJ-8: store scan, renamed, cast, NULL chain/revenue dropped."""
    return inputs.stores(spark, sf)


@register("ldu_union", ["POSTALCODE", "PROV", "LONGITUDE", "LATITUDE", "AREA"], "SELECT * FROM ldu_union")
def ldu_union(spark, sf):
    """SET-1: SQL UNION (distinct) of the two polygon parts."""
    return tables.union_distinct(fx.ldu_part1(spark, sf), fx.ldu_part2(spark, sf))


@register("ldu_centroid", ["POSTALCODE", "PROV", "LONGITUDE", "LATITUDE"], "SELECT * FROM ldu")
def ldu_centroid(spark, sf):
    """SRC-3 / AGG-1 / SRT-1: centroid of the largest polygon per postal code."""
    return inputs.ldu(spark, sf)


PAIR_COLS = ["STORE_NUM", "STORE_NAME", "STORE_PROVINCE", "POSTALCODE", "PROV"]


@register("adjacency_pairs", PAIR_COLS, "SELECT * FROM pairs")
def adjacency_pairs(spark, sf):
    """JOIN-1 / F-2 / UDF-1: stores x postal codes of the same or an adjacent
    province (broadcast equi-join on the adjacency table), store by store."""
    return adjm.pairs_by_store(inputs.stores(spark, sf), inputs.ldu(spark, sf))


@register("province_pairs", ["STORE_PROVINCE", "PROV"], "SELECT DISTINCT STORE_PROVINCE, PROV FROM pairs")
def province_pairs(spark, sf):
    """SRT-3 / AGG-7: distinct (store province, postal province) pairs, sorted.
    A province is reached by all of its stores or none, so one store and one
    postal code of each province give every pair of provinces."""
    stores = inputs.stores(spark, sf).dropDuplicates(["STORE_PROVINCE"])
    return adjm.province_pairs(adjm.pairs(stores, inputs.ldu(spark, sf).dropDuplicates(["PROV"])))


@register("haversine", ["STORE_NUM", "POSTALCODE", "HAVERSINE_DISTANCE"], "SELECT * FROM pairs")
def haversine(spark, sf):
    """FN-1 / UDF-2: great-circle distance per pair (native expression)."""
    return att.attraction(inputs.stores(spark, sf), inputs.ldu(spark, sf), by_store=True)


@register("attraction", ["STORE_NUM", "POSTALCODE", "REVENUE_CY", "HAVERSINE_DISTANCE", "Attraction"], "SELECT * FROM att")
def attraction(spark, sf):
    """FN-2: gravity attraction revenue / distance^2 (NULL at distance 0)."""
    a = att.attraction(inputs.stores(spark, sf), inputs.ldu(spark, sf), by_store=True)
    return a.withColumn("Attraction", gravity("REVENUE_CY", "HAVERSINE_DISTANCE"))


@register(
    "attraction_total",
    ["STORE_NUM", "POSTALCODE", "Attraction", "TOTAL_POSTALCODE_ATTRACTION"],
    "SELECT * FROM att_tot",
)
def attraction_total(spark, sf):
    """WIN-1: total attraction per postal code."""
    return att.postal_total(att.attraction(inputs.stores(spark, sf), inputs.ldu(spark, sf)))


@register("attraction_cumulative", FULL, "SELECT * FROM att_full")
def attraction_cumulative(spark, sf):
    """WIN-2 / SRT-2 / PRJ-1: the full attraction table with the running share."""
    return inputs.full_attraction(spark, sf)


@register("attraction_cumulative_split", FULL, "SELECT * FROM att_full")
def attraction_cumulative_split(spark, sf):
    """WIN-2 / SRT-2: the running share from two-level prefix sums, for postal
    codes that very many stores reach."""
    keyed = att.keyed_stores(inputs.stores(spark, sf))
    return keyed.attach(att.running_share_split(keyed, inputs.ldu(spark, sf)))


EXCL_MAX_SQL = f"""SELECT *, sum(Attraction / nullif(TOTAL_POSTALCODE_ATTRACTION, 0)) OVER (
  PARTITION BY POSTALCODE ORDER BY {O.RUNNING_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS CUMULATIVE_PERCENT_ATTRACTION
FROM (SELECT *, sum(Attraction) OVER (PARTITION BY POSTALCODE) - max(Attraction) OVER (PARTITION BY POSTALCODE)
  AS TOTAL_POSTALCODE_ATTRACTION FROM att) t"""


@register(
    "attraction_excl_max",
    ["STORE_NUM", "POSTALCODE", "Attraction", "TOTAL_POSTALCODE_ATTRACTION", "CUMULATIVE_PERCENT_ATTRACTION"],
    EXCL_MAX_SQL,
)
def attraction_excl_max(spark, sf):
    """WIN-4: postal total without the strongest store (sum - max), with the
    running share on that total."""
    keyed = att.keyed_stores(inputs.stores(spark, sf))
    a = keyed.pairs(inputs.ldu(spark, sf))
    return keyed.attach(att.running_share(att.postal_total(a, exclude_max=True)))


@register(
    "attraction_max",
    ["STORE_NUM", "POSTALCODE", "Attraction", "Max_Attraction"],
    "SELECT *, max(Attraction) OVER (PARTITION BY POSTALCODE) AS Max_Attraction FROM att",
)
def attraction_max(spark, sf):
    """WIN-5: strongest attraction per postal code."""
    return att.postal_max(att.attraction(inputs.stores(spark, sf), inputs.ldu(spark, sf)))


@register("attraction_half_pct", SHARES, "SELECT * FROM att_half")
def attraction_half_pct(spark, sf):
    """F-3 / WIN-3 / SRC-6: shares after the 0.5% cut (flagship)."""
    return inputs.half_pct(spark, sf)


@register("attraction_full_pct", SHARES, "SELECT * FROM att_onep")
def attraction_full_pct(spark, sf):
    """F-4: shares after the 1% cut."""
    return inputs.one_pct(spark, sf)


@register(
    "attraction_tail_trim",
    SHARES,
    """SELECT *, Attraction / nullif(sum(Attraction) OVER (PARTITION BY POSTALCODE), 0) AS PERCENT_ATTRACTION
FROM att_full WHERE CUMULATIVE_PERCENT_ATTRACTION > CAST(0.01 AS DOUBLE)""",
)
def attraction_tail_trim(spark, sf):
    """F-5: drop the weakest stores up to a 1% running share, renormalise."""
    keyed = att.keyed_stores(inputs.stores(spark, sf))
    full = att.running_attraction(keyed, inputs.ldu(spark, sf))
    return keyed.attach(att.trim_tail(full, att.ONE_PERCENT))


@register(
    "postal_lookup",
    ["STORE_NUM", "POSTALCODE", "Attraction", "TOTAL_POSTALCODE_ATTRACTION", "CUMULATIVE_PERCENT_ATTRACTION"],
    f"SELECT * FROM att_full WHERE POSTALCODE = '{LOOKUP_POSTALCODE}'",
)
def postal_lookup(spark, sf):
    """F-6: one postal code's attraction, total and running share (the filter
    on the window partition key is pushed below the windows and the join)."""
    return inputs.full_attraction(spark, sf).filter(F.col("POSTALCODE") == LOOKUP_POSTALCODE)
