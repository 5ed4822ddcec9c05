"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, root): every node with an edge and the smallest node it is
    connected to (roots themselves have no row).

    ``edges`` are (u, v) rows of longs.  A large star links every larger
    neighbour of a node to the smallest one, a small star every smaller or
    equal one; no neighbour list is ever collected, a node's minimum is a
    partial aggregate, so a hub does not gather in one task.  Each round is
    written to the shared folder; rounds grow with the logarithm of the
    component size.
    """
    stars = written(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        stars = written(small.filter("u <> v").distinct(), "stars")
        new = _state(stars)
        if new == state:
            return stars.select("u", F.col("v").alias("root"))
        state = new
