"""Gravity attraction, per-postal-code totals, running shares and share cuts.

Layout: the postal-code side is hash-partitioned by POSTALCODE before the
broadcast pair join, with a partition count that follows the pairs counted by
province, so a task sorts its pairs in memory; every window here is
partitioned by POSTALCODE, so the whole chain (pairs, distance, attraction,
total, running share, cut, renormalised share) runs without another exchange.
A window group is one postal code: at most one row per store that reaches it,
so its size is bounded by the store side, whose size the pair join checks.

Pairs that are sorted carry a store's number, which follows the tie-break, in
place of its twelve columns (``keyed_stores``); those are attached to the rows
that are done.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.geo import gravity, haversine_km
from ..plans.layout import fits_broadcast, join_keyed, materialize, numbered, shuffle_partitions
from .adjacency import pairs, pairs_by_store, stores_with_reach


def by_postal() -> Window:
    return Window.partitionBy("POSTALCODE")


# Tie-break after the share for the running share: every store attribute
# and the postal province, so rows with equal shares are always ordered the
# same way (a recomputed partition gives the same running sums).
RUNNING_TIEBREAK = [
    "STORE_NUM", "STORE_NAME", "CUSTOMER_GROUP", "BANNER", "STORE_STREET", "CHANNEL", "SALES_GROUP",
    "STORE_PROVINCE", "STORE_LATITUDE", "STORE_LONGITUDE", "REVENUE_CY", "PROV",
]

# Share cuts of the two published tables.
HALF_PERCENT = 0.005
ONE_PERCENT = 0.01


#: Pairs that a task sorts for the windows, in memory.
PAIRS_A_TASK = 1_000_000


def pair_partitions(stores: DataFrame, ldu: DataFrame) -> int:
    """Partitions of which each makes about ``PAIRS_A_TASK`` pairs: a multiple
    of the session's count, so a bucket of that count is a whole number of
    partitions.  The pairs are counted from the rows by province."""
    reached = stores_with_reach(stores.groupBy("STORE_PROVINCE").agg(F.count(F.lit(1)).alias("__s")))
    codes = ldu.groupBy("PROV").agg(F.count(F.lit(1)).alias("__c"))
    counted = codes.join(reached, codes["PROV"] == reached["LDU_PROV"]).agg(F.sum(F.col("__s") * F.col("__c"))).first()[0]
    n = shuffle_partitions(ldu)
    return n * max(1, math.ceil((counted or 0) / (PAIRS_A_TASK * n)))


def layout_postal(ldu: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partition postal codes by POSTALCODE (explicit count: the pair join
    multiplies every row by the stores that reach it, so the partition count
    must follow the pair volume, not the small postal-code table)."""
    return ldu.repartition(partitions or shuffle_partitions(ldu), "POSTALCODE")


def in_code_order(laid: DataFrame) -> DataFrame:
    """``laid`` with each task's rows sorted by POSTALCODE, all rows kept.  The
    optimizer drops a plain sort below a join; the sort of a window that a
    filter reads stays, the pairs come out in that order, and windows over a
    postal code need not sort them."""
    rows = F.count(F.lit(1)).over(by_postal())
    return laid.withColumn("__rows", rows).filter("__rows > 0").drop("__rows")


def attraction(stores: DataFrame, ldu: DataFrame, mass: str = "REVENUE_CY", partitions: int | None = None,
               by_store: bool = False) -> DataFrame:
    """Store x postal-code pairs (adjacent provinces) with HAVERSINE_DISTANCE
    and Attraction = mass / distance^2.  ``mass`` names the store column used
    as mass (revenue, sales, ...).  With ``by_store`` the pairs come store by
    store, which makes smaller files but has no layout for windows."""
    if by_store:
        p = pairs_by_store(stores, ldu, partitions)
    else:
        p = pairs(stores, in_code_order(layout_postal(ldu, partitions or pair_partitions(stores, ldu))))
    return measured(p, mass)


def measured(p: DataFrame, mass: str = "REVENUE_CY") -> DataFrame:
    """Pairs with their HAVERSINE_DISTANCE and Attraction."""
    dist = haversine_km("STORE_LATITUDE", "STORE_LONGITUDE", "LATITUDE", "LONGITUDE")
    return p.withColumn("HAVERSINE_DISTANCE", dist).withColumn("Attraction", gravity(mass, "HAVERSINE_DISTANCE"))


#: A store's number in pairs, instead of its columns.
STORE_KEY = "__store"


@dataclass(frozen=True)
class KeyedStores:
    """Stores for pairs that are sorted.  ``pairs`` makes them with the store's
    number and none of its columns, ``attach`` puts the columns on rows that
    are done.  Without ``attributes`` the pairs carry all columns throughout."""

    stores: DataFrame
    attributes: DataFrame | None = None

    @property
    def ties(self) -> list[str]:
        return RUNNING_TIEBREAK if self.attributes is None else [STORE_KEY, "PROV"]

    def narrow(self, measured_pairs: DataFrame, columns: list[str]) -> DataFrame:
        if self.attributes is None:
            return measured_pairs
        return measured_pairs.select(*columns, STORE_KEY, "HAVERSINE_DISTANCE", "Attraction")

    def pairs(self, ldu: DataFrame, mass: str = "REVENUE_CY", partitions: int | None = None) -> DataFrame:
        return self.narrow(attraction(self.side(mass), ldu, mass, partitions), ldu.columns)

    def side(self, mass: str) -> DataFrame:
        """What a pair is computed from, each store as often as it was given."""
        if self.attributes is None:
            return self.stores
        needed = dict.fromkeys([STORE_KEY, "STORE_PROVINCE", "STORE_LATITUDE", "STORE_LONGITUDE", mass])
        return self.stores.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*needed)

    def attach(self, rows: DataFrame) -> DataFrame:
        if self.attributes is None:
            return rows
        return rows.join(F.broadcast(self.attributes), STORE_KEY).drop(STORE_KEY)


def keyed_stores(stores: DataFrame) -> KeyedStores:
    """Numbers the stores in the order of the tie-break (equal rows have one
    number), if they measure less than the broadcast bound."""
    if not fits_broadcast(stores):
        return KeyedStores(stores)
    first = [c for c in RUNNING_TIEBREAK if c in stores.columns]
    columns = [*first, *[c for c in stores.columns if c not in first]]
    distinct = stores.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies")).select(*columns, "__copies")
    found = numbered(distinct, STORE_KEY)
    return KeyedStores(found, found.drop("__copies"))


def postal_total(att: DataFrame, exclude_max: bool = False) -> DataFrame:
    """TOTAL_POSTALCODE_ATTRACTION: sum of Attraction over the postal code;
    with ``exclude_max`` the strongest store is left out (sum - max)."""
    total = F.sum("Attraction").over(by_postal())
    if exclude_max:
        total = total - F.max("Attraction").over(by_postal())
    return att.withColumn("TOTAL_POSTALCODE_ATTRACTION", total)


def postal_max(att: DataFrame) -> DataFrame:
    """Max_Attraction: the strongest store's attraction per postal code."""
    return att.withColumn("Max_Attraction", F.max("Attraction").over(by_postal()))


def _share() -> Column:
    return F.try_divide(F.col("Attraction"), F.col("TOTAL_POSTALCODE_ATTRACTION"))


def running_share(att: DataFrame) -> DataFrame:
    """CUMULATIVE_PERCENT_ATTRACTION: running sum of the share, weakest store
    first (ROWS frame; ties broken by store attributes, or by the number that
    follows them)."""
    ties = [STORE_KEY, "PROV"] if STORE_KEY in att.columns else RUNNING_TIEBREAK
    order = [_share().asc()] + [F.col(c).asc() for c in ties]
    w = by_postal().orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return att.withColumn("CUMULATIVE_PERCENT_ATTRACTION", F.sum(_share()).over(w))


def running_share_split(stores: KeyedStores, ldu: DataFrame, mass: str = "REVENUE_CY", partitions: int | None = None,
                        piece: int = PAIRS_A_TASK) -> DataFrame:
    """``running_share(postal_total(pairs))`` where one postal code may be
    reached by more stores than a task should hold: two-level running sums
    over pieces of a code's pairs, of about ``piece`` pairs each.

    Pairs are neither shuffled nor written: they are made again for each step,
    a code once for each of its pieces, which keeps the pairs between two
    bounds.  Totals and the pieces' sums are grouped sums, the bounds are a
    hashed one in ``piece`` of the code's own pairs (only codes with more
    pairs than that have any), and a piece's start is the sum of those before
    it."""
    n = partitions or pair_partitions(stores.side(mass), ldu)
    total = F.sum("Attraction").alias("TOTAL_POSTALCODE_ATTRACTION")
    totals = stores.pairs(ldu, mass, n).groupBy("POSTALCODE").agg(total, F.count(F.lit(1)).alias("__rows"))
    codes = materialize(join_keyed(ldu, totals, ["POSTALCODE"], "inner"))
    place = F.struct(_share().alias("share"), *stores.ties)

    def made(laid: DataFrame, *by: str) -> DataFrame:
        met = pairs(stores.side(mass), laid.repartition(n, "POSTALCODE", *by), by=["POSTALCODE", *by])
        return stores.narrow(measured(met, mass), laid.columns)

    chosen = F.pmod(F.xxhash64("POSTALCODE", *stores.ties), F.lit(piece).cast("long")) == 0
    bounds = made(codes.filter(F.col("__rows") > piece)).filter(chosen).groupBy("POSTALCODE").agg(
        F.sort_array(F.collect_set(place)).alias("__bounds")
    )
    last = F.when(F.col("__bounds").isNull(), 0).otherwise(F.size("__bounds"))
    cut = join_keyed(codes, bounds, ["POSTALCODE"]).withColumn("__piece", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.get("__bounds", F.col("__piece") - 1), F.get("__bounds", "__piece")
    pieces = materialize(cut.withColumns({"__low": low, "__high": high}).drop("__bounds", "__rows"))

    def within(laid: DataFrame) -> DataFrame:
        low, high = F.col("__low"), F.col("__high")
        kept = made(laid, "__piece").filter((low.isNull() | (low <= place)) & (high.isNull() | (place < high)))
        return kept.drop("__low", "__high")

    before = Window.partitionBy("POSTALCODE").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    several = F.col("__low").isNotNull() | F.col("__high").isNotNull()
    sums = within(pieces.filter(several)).groupBy("POSTALCODE", "__piece").agg(F.sum(_share()).alias("__sum"))
    starts = sums.select("POSTALCODE", "__piece", F.sum("__sum").over(before).alias("__start"))
    rows = within(join_keyed(pieces, starts, ["POSTALCODE", "__piece"]))
    order = [_share().asc()] + [F.col(c).asc() for c in stores.ties]
    w = Window.partitionBy("POSTALCODE", "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__within", F.sum(_share()).over(w))
    running = F.coalesce(F.col("__start") + F.col("__within"), "__start", "__within")
    return rows.withColumn("CUMULATIVE_PERCENT_ATTRACTION", running).drop("__piece", "__start", "__within")


def running_attraction(stores: KeyedStores, ldu: DataFrame, mass: str = "REVENUE_CY", partitions: int | None = None) -> DataFrame:
    """Pairs, distance, attraction, postal total and running share, before the
    stores' columns are attached."""
    return running_share(postal_total(stores.pairs(ldu, mass, partitions)))


def full_attraction(stores: DataFrame, ldu: DataFrame, mass: str = "REVENUE_CY", partitions: int | None = None) -> DataFrame:
    """The full attraction table: pairs, distance, attraction, postal total
    and running share (19 columns)."""
    keyed = keyed_stores(stores)
    return keyed.attach(running_attraction(keyed, ldu, mass, partitions)).select(*schemas.ATTRACTION_COLUMNS)


def renormalise(df: DataFrame) -> DataFrame:
    """PERCENT_ATTRACTION: attraction over the postal code's remaining total,
    so the kept shares of a postal code sum to 1."""
    return df.withColumn("PERCENT_ATTRACTION", F.try_divide(F.col("Attraction"), F.sum("Attraction").over(by_postal())))


def shares(full: DataFrame, min_share: float = HALF_PERCENT) -> DataFrame:
    """Keep pairs with Attraction > min_share x postal total (strict), then
    renormalise.  A NULL attraction never passes."""
    kept = full.filter(F.col("Attraction") > F.lit(float(min_share)) * F.col("TOTAL_POSTALCODE_ATTRACTION"))
    return renormalise(kept).select(*schemas.SHARE_COLUMNS)


def trim_tail(full: DataFrame, cum: float = ONE_PERCENT) -> DataFrame:
    """Drop the weakest stores whose running share is at most ``cum``, then
    renormalise.  Rows that carry a store's number keep it, for its columns to
    be attached."""
    kept = renormalise(full.filter(F.col("CUMULATIVE_PERCENT_ATTRACTION") > F.lit(float(cum))))
    return kept if STORE_KEY in full.columns else kept.select(*schemas.SHARE_COLUMNS)
