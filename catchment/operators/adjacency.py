"""Province adjacency as data, and the store x postal-code pair join.

The adjacency rule (a store reaches postal codes of its own and of
neighbouring provinces) is a 46-row table joined on equality, so the pair
generation is an equi-join instead of a cross join with a row filter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.layout import maybe_broadcast, shuffle_partitions
from ..sources.tables import local_table

# ---------------------------------------------------------------------------
# Postal-code provinces reachable from a store's province.
# The relation is not symmetric (NL reaches PE, PE does not reach NL) and has
# 46 ordered pairs.  Store provinces not listed reach nothing.
# ---------------------------------------------------------------------------
REACHABLE_PROVINCES = {
    "AB": ["AB", "BC", "SK", "NT"],
    "BC": ["AB", "BC", "YT"],
    "SK": ["AB", "MB", "SK", "NT"],
    "MB": ["ON", "MB", "SK", "NU"],
    "ON": ["ON", "MB", "QC"],
    "QC": ["ON", "NL", "QC", "NB"],
    "NB": ["QC", "NS", "NB", "PE"],
    "NL": ["NL", "QC", "PE"],
    "YT": ["YT", "NT", "BC"],
    "NS": ["NS", "NB", "PE"],
    "NT": ["NT", "YT", "NU", "AB", "SK"],
    "NU": ["NT", "NU", "MB"],
    "PE": ["PE", "NS", "NB"],
}


def adjacency(spark: SparkSession) -> DataFrame:
    """(STORE_PROV, LDU_PROV) pairs a store may reach."""
    rows = [(s, p) for s, provs in REACHABLE_PROVINCES.items() for p in provs]
    schema = T.StructType([T.StructField("STORE_PROV", T.StringType()), T.StructField("LDU_PROV", T.StringType())])
    return local_table(spark, rows, schema)


def stores_with_reach(stores: DataFrame, adj: DataFrame | None = None) -> DataFrame:
    """Each store once per province it reaches (column LDU_PROV)."""
    adj = adjacency(stores.sparkSession) if adj is None else adj
    return stores.join(adj, stores["STORE_PROVINCE"] == adj["STORE_PROV"]).drop("STORE_PROV")


def pairs(stores: DataFrame, ldu: DataFrame, adj: DataFrame | None = None, salt_buckets: int | None = None,
          by: list[str] | None = None) -> DataFrame:
    """Every (store, postal code) whose provinces are adjacent.

    ``ldu`` should be hash-partitioned by POSTALCODE: with the store side
    broadcast the join keeps that layout, so the per-postal-code windows that
    follow need no exchange.  The store side is tiny in practice (thousands of
    stores times at most five provinces); its size is checked.

    Beyond the bound a two-way salted shuffle join runs: postal codes get a
    deterministic bucket out of k and are copied to the k store buckets,
    stores get a bucket out of k and are copied to the k postal buckets, and
    the join is on (province, postal bucket, store bucket).  Every pair meets
    in exactly one of the k x k cells of its province, each side is copied
    only k times (k = sqrt(partitions / 13)), and a province holding a large
    share of postal codes and stores is spread over k x k tasks.  The pairs
    are dealt by the columns ``by`` of ``ldu`` (POSTALCODE) after it.
    """
    reach = stores_with_reach(stores, adj)
    side, is_broadcast = maybe_broadcast(reach)
    if is_broadcast:
        return ldu.join(side, ldu["PROV"] == side["LDU_PROV"]).drop("LDU_PROV")

    n = shuffle_partitions(ldu)
    k = salt_buckets or max(1, math.ceil(math.sqrt(n / 13)))
    buckets = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    l = ldu.withColumn("__lb", F.pmod(F.xxhash64("POSTALCODE"), F.lit(k).cast("long"))).withColumn("__sb", buckets)
    store_key = F.xxhash64(*[F.col(c) for c in reach.columns if c != "LDU_PROV"])
    r = reach.withColumn("__sb", F.pmod(store_key, F.lit(k).cast("long"))).withColumn("__lb", buckets)
    cond = (l["PROV"] == r["LDU_PROV"]) & (l["__lb"] == r["__lb"]) & (l["__sb"] == r["__sb"])
    joined = l.join(r, cond)
    return joined.drop("LDU_PROV", "__lb", "__sb").repartition(n, *(by or ["POSTALCODE"]))


#: Lists of postal codes that ``pairs_by_store`` makes of a province, for each task.
LISTS_A_TASK = 4
#: Pairs that one list makes with one bucket of stores.  Spark's generated code
#: holds all that a row is joined and spread into before the next is taken.
PAIRS_A_MEETING = 50_000


def pairs_by_store(stores: DataFrame, ldu: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of ``pairs``, store by store: the postal codes of a province
    are dealt into lists, a store meets a whole list, and the list is spread
    into pairs last.  Rows that follow each other share the store, and the
    same codes come again for the next one, so a columnar file of the pairs is
    a small part of one in code order.  For results without windows: the
    pairs are not laid out by POSTALCODE.

    A list meets the stores bucket by bucket, so that what is made of a row
    at once stays bounded however many stores there are.  Beyond the broadcast
    bound lists and buckets are joined by a shuffle; no pair is shuffled."""
    names, n = ldu.columns, partitions or shuffle_partitions(ldu)
    dealt = ldu.withColumn("__list", F.pmod(F.xxhash64(*names), F.lit(LISTS_A_TASK * n).cast("long")))
    codes = F.collect_list(F.struct(*[c for c in names if c != "PROV"])).alias("__codes")
    reach = stores_with_reach(stores)
    side, is_broadcast = maybe_broadcast(reach)
    k = max(store_buckets(reach, ldu, LISTS_A_TASK * n), 1 if is_broadcast else math.ceil(n / 13))
    store_key = F.xxhash64(*[F.col(c) for c in reach.columns if c != "LDU_PROV"])
    side = side.withColumn("__sb", F.pmod(store_key, F.lit(k).cast("long")))
    side = F.broadcast(side) if is_broadcast else side
    # each code once a bucket, within its task; the aggregate that follows ends the generated code
    laid = dealt.repartition(n, "PROV", "__list")
    laid = laid.withColumn("__lb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    lists = laid.groupBy("PROV", "__list", "__lb").agg(codes)
    on = (F.col("PROV") == F.col("LDU_PROV")) & (F.col("__lb") == F.col("__sb"))
    kept = [F.col(c) for c in stores.columns]
    made = lists.join(side, on).select("PROV", *kept, F.explode("__codes").alias("__code"))
    return made.select(*[F.col("PROV" if c == "PROV" else f"__code.{c}") for c in names], *kept)


def store_buckets(reach: DataFrame, ldu: DataFrame, lists: int) -> int:
    """Buckets of a province's stores of which a list, one of ``lists`` of the
    province, makes about ``PAIRS_A_MEETING`` pairs with one."""
    stores = reach.groupBy("LDU_PROV").agg(F.count(F.lit(1)).alias("__s"))
    codes = ldu.groupBy("PROV").agg(F.count(F.lit(1)).alias("__c"))
    most = codes.join(stores, codes["PROV"] == stores["LDU_PROV"]).agg(F.max(F.col("__s") * F.col("__c"))).first()[0]
    return max(1, math.ceil((most or 0) / (lists * PAIRS_A_MEETING)))


def province_pairs(pair_df: DataFrame) -> DataFrame:
    """Distinct (store province, postal province) pairs present, sorted
    (the adjacency check of the source pipeline)."""
    return pair_df.select("STORE_PROVINCE", "PROV").distinct().orderBy("STORE_PROVINCE", "PROV")
