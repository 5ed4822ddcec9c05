"""Physical-layout helpers: size-checked broadcasts, partition counts, and
keyed totals that pre-aggregate before shuffling.

Rules followed throughout the package:

* A base or dimension table is broadcast only after its size in bytes was
  measured against a bound (``fits_broadcast``); beyond the bound the code
  takes a shuffle path.  A derived side (an aggregate) is left to adaptive
  execution, which broadcasts it only when its materialized size is under the
  adaptive threshold and keeps the sort-merge join otherwise.
* Totals over a key are grouped aggregates (partial aggregation on the map
  side, so a hot key is combined before the shuffle) joined back to the rows,
  not whole-partition windows, unless the group size is bounded by a checked
  dimension (documented at each window).
* Repartitions that a later broadcast join fans out use an explicit count so
  adaptive execution does not coalesce them by their (small) input size.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default bound for broadcast sides, in bytes.  Overridable per session with
# ``spark.conf.set("catchment.broadcast.maxBytes", ...)``.
DEFAULT_BROADCAST_MAX_BYTES = 64 << 20


def broadcast_max_bytes(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("catchment.broadcast.maxBytes", str(DEFAULT_BROADCAST_MAX_BYTES)))


def table_bytes(df: DataFrame) -> int:
    """Size of ``df``'s values, measured: bytes of text, eight of any other
    column, and sixteen a row.  A grouped sum, so no rows meet in one task."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    size = F.lit(16 + 8 * (len(df.columns) - len(text)))
    for c in text:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 8
    return int(df.agg(F.sum(size.cast("long"))).first()[0] or 0)


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    """True when ``df`` measures at most ``max_bytes``."""
    return table_bytes(df) <= (broadcast_max_bytes(df) if max_bytes is None else max_bytes)


def maybe_broadcast(df: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when the size check passes, else ``(df, False)``."""
    if fits_broadcast(df, max_bytes):
        return F.broadcast(df), True
    return df, False


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition ``left.k <=> right.k`` for every key (NULL keys group
    together, as they do in a window partition or GROUP BY)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_keyed(df: DataFrame, totals: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach per-key ``totals`` (one row per key) to ``df`` on ``keys``,
    NULL-safe.

    ``totals`` is the output of a grouped aggregate, i.e. of a shuffle stage:
    adaptive execution knows its exact size once that stage ran and turns the
    join into a broadcast join when it is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise a sort-merge
    join runs, where adaptive skew handling splits hot keys of ``df``.
    """
    t = totals
    for k in keys:
        t = t.withColumnRenamed(k, f"__k_{k}")
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(t[f"__k_{k}"]) for k in keys])
    return df.join(t, cond, how).drop(*[f"__k_{k}" for k in keys])


def keyed_totals(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """``df`` with one extra column per entry of ``aggs``, each aggregated over
    the rows sharing ``keys`` (like ``agg.over(Window.partitionBy(keys))``).

    Computed as a grouped aggregate (map-side partial aggregation: a key that
    holds a third of all rows is combined before the shuffle) joined back on
    the keys, so no task ever holds a whole hot group.
    """
    totals = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return join_keyed(df, totals, keys)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the
    written copy (it survives executor loss).  Used where a stage is read more
    than once (self-joins), so its upstream plan is neither copied into every
    branch nor recomputed.  The copy is Parquet: readers take only the columns
    they need, and the planner knows its size.  It is removed when the
    application ends."""
    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/copy-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` (distinct) with a dense number from 0 in column
    ``name``, in the order of all columns.

    Rows are sorted by range and numbered within their task; the written
    copy's counts, one a task, give each task's first number.  No task and not
    the driver holds all rows, and the written numbers never change."""
    keys = df.columns
    place = F.monotonically_increasing_id()  # task << 33 | row of the task, fixed by the write
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", place)
    copy = materialize(sorted_rows)
    task, row = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in copy.groupBy(task.alias("__task")).count().collect())  # a row a task
    starts, at = [], 0
    for number, rows in counts:
        starts += [F.lit(number), F.lit(at)]
        at += rows
    start = F.element_at(F.create_map(*starts), task) if starts else F.lit(0)
    return copy.select((start + row).cast("long").alias(name), *keys)


def prefix_sums(
    df: DataFrame, group: list[str], order: list[str], value: str, name: str, partitions: int | None = None
) -> DataFrame:
    """``df`` with the running sum of ``value`` within ``group``, in the order
    of the columns ``order`` (ascending, NULLs first; together with ``group``
    they tell all rows apart), as column ``name``.

    Two levels, so that no task holds a whole group: the rows are dealt by
    range of (group, order) into pieces and written once, which fixes the
    pieces; sums run within each (group, piece), and a group's pieces, at most
    one a partition, get their starts from the sums of the pieces before."""
    ranged = df.repartitionByRange(partitions or shuffle_partitions(df), *group, *order)
    copy = materialize(ranged.withColumn("__piece", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = copy.groupBy(*group, "__piece").agg(F.sum(value).alias("__sum"))
    starts = sums.select(*group, "__piece", F.sum("__sum").over(before).alias("__start"))
    within = Window.partitionBy(*group, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = join_keyed(copy.withColumn("__within", F.sum(value).over(within)), starts, [*group, "__piece"])
    total = F.coalesce(F.col("__start") + F.col("__within"), "__start", "__within")
    return rows.withColumn(name, total).drop("__piece", "__start", "__within")
