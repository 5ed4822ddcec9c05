"""Ranks of a linked list that no task holds.

Some elements, chosen by a hash, are rulers.  Every element jumps along the
list, doubling its step, until it points to a ruler or past the end; the
rulers alone are then a shorter list with weights, ranked in the same way,
and the others add their distance to the ruler they reached.  A list of at
most ``BASE`` elements is walked in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import ship_package, written

#: One element in RULERS is a ruler; lists of BASE elements are walked.
RULERS, BASE = 8, 4_096


def list_ranks(links: DataFrame, base: int = BASE) -> DataFrame:
    """(a, rank): how many steps lead from each element past the end.

    ``links`` are (a, n, w) of one list: an element, the next one (null at
    the end) and the steps to it.
    """
    ship_package(links.sparkSession)
    return _ranks(written(links.select("a", "n", "w"), "links"), base, 0)


def _ranks(links: DataFrame, base: int, level: int) -> DataFrame:
    if links.count() <= base:
        walk = links.coalesce(1).mapInArrow(_walk, links.select("a", F.col("w").alias("rank")).schema)
        return written(walk, "ranks")
    ruler = functools.partial(_is_ruler, level=level)
    done = [links.filter(F.col("n").isNull() | ruler("n"))]
    active = links.filter(F.col("n").isNotNull() & ~ruler("n"))
    while not active.isEmpty():
        table = functools.reduce(DataFrame.unionByName, done, active).filter(~ruler("a"))
        ahead = table.select(F.col("a").alias("n"), F.col("n").alias("__n"), F.col("w").alias("__w"))
        jumped = active.join(ahead, "n").select("a", F.col("__n").alias("n"), (F.col("w") + F.col("__w")).alias("w"))
        arrived = F.col("n").isNull() | ruler("n")
        stage = written(jumped.withColumn("arrived", arrived), "jumps", ["arrived"])
        done.append(stage.filter("arrived").drop("arrived"))
        active = stage.filter("NOT arrived").drop("arrived")
    reached = functools.reduce(DataFrame.unionByName, done)
    rulers = _ranks(written(reached.filter(ruler("a")), "rulers"), base, level + 1)
    rest = reached.join(rulers.select(F.col("a").alias("n"), "rank"), "n", "left")
    return written(rest.select("a", (F.col("w") + F.coalesce("rank", F.lit(0))).alias("rank")), "ranks")


def _is_ruler(element: str, level: int) -> Column:
    return F.pmod(F.xxhash64(element, F.lit(level)), F.lit(RULERS)) == 0


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole (short) list, from its end back."""
    tables = list(batches)
    if not tables:
        return
    rows = pa.Table.from_batches(tables)
    ids, nexts, weights = (rows.column(c).to_pylist() for c in ("a", "n", "w"))
    key = lambda x: tuple(x.values()) if isinstance(x, dict) else x
    before = {key(n): i for i, n in enumerate(nexts)}
    ranks, at, rank = [0] * len(ids), before.get(None), 0
    while at is not None:
        rank += weights[at]
        ranks[at] = rank
        at = before.get(key(ids[at]))
    for batch in pa.table([rows.column("a"), pa.array(ranks, pa.int64())], ["a", "rank"]).to_batches():
        yield batch
