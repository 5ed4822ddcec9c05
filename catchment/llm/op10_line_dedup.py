"""Line dedup over levelled sorted runs of line hashes.

Method.  Lines long enough to count become (key, document, line number) rows
once, in a written table split into batches by document id, the largest ids
first.  A batch is reduced to one row per key (number of documents, largest
document id) and merge-anti-joined with the runs so far: keys that no run
holds are the batch's own new run, sorted by key, and their keeper (the
largest document id with that line) is final, because later batches only
hold smaller ids.  Keys that a run already holds only add their document
counts, as a run without keeper.  ``FANOUT`` runs of a level are compacted
into one of the next level (counts added, keeper kept), so a key lies in few
runs.  A last compaction gives each key's count and keeper; lines of keys
with enough documents are dropped everywhere but in the keeper.

Counts are aggregated before every shuffle, so a line that a third of the
documents share is one row per task.  Lines are kept by their number in the
text, so only (document, text hash, line number) rows travel back to the texts.

Defined results: a null or empty text is one empty line; rows with the same
id are one document, whatever their texts, so all of them keep its lines or
lose them; a null id is one document below all others; lines repeated inside
a document count it once, and the keeper keeps all of them; an empty table gives an empty result; extra
columns are carried by ``dedup_lines`` untouched (its own columns start with
``__ld_``), and left out of the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import new_path, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of document ids, and runs of a level that are compacted into one.
BATCHES, FANOUT = 4, 2

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased (``lower`` does
    just that on pure ASCII, much faster than ``translate``)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, doc, mark, pos) of every line whose key has ``min_chars`` code
    points; the key is its MD5, 16 bytes, ``mark`` the text's hash."""
    return (
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        .filter(F.length(F.btrim("line", F.lit(BLANKS))) >= min_chars)
        .select(F.unhex(F.md5(line_key(F.col("line")))).alias("key"), "doc", "mark", "pos")
    )


class Runs:
    """Levelled runs of (key, n_docs, keeper), each a table sorted by key."""

    def __init__(self, fanout: int) -> None:
        self.fanout, self.levels = fanout, []

    def all(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    @staticmethod
    def compacted(runs: DataFrame) -> DataFrame:
        return runs.groupBy("key").agg(
            F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("has_keeper").alias("has_keeper")
        )

    def add(self, run: DataFrame, level: int = 0) -> None:
        run = written(run.sortWithinPartitions("key"), f"line-run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = None
            for r in self.levels[level]:
                merged = r if merged is None else merged.unionByName(r)
            self.levels[level] = []
            self.add(self.compacted(merged), level + 1)


def id_cuts(docs: DataFrame, id_col: str, batches: int) -> list:
    """The smallest ids of all but the last batch, largest first, from Spark's
    own range bounds: of the id's type, whatever it is."""
    if batches < 2:
        return []
    ids = docs.select(F.col(id_col).alias("v")).filter("v IS NOT NULL").repartitionByRange(batches, "v")
    lows = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("v").alias("low")).collect()
    lows = sorted(r["low"] for r in lows)
    return sorted({lows[len(lows) * i // batches] for i in range(1, batches)} if lows else [], reverse=True)


def common_lines(
    docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int
) -> DataFrame:
    """(doc, text hash, drops): the line numbers each document loses."""
    spark = docs.sparkSession
    # Batch bounds only set how much is read at a time; results don't depend on them.
    batch = F.lit(0)
    for cut in id_cuts(docs, id_col, batches):
        batch = batch + F.when(F.col("doc") >= F.lit(cut), 0).otherwise(1)
    path = new_path(spark, "lines")
    keyed = keyed_lines(docs, id_col, text_col, min_chars).withColumn("batch", batch)
    keyed.write.partitionBy("batch").parquet(path)
    schema = keyed.schema
    lines = spark.read.schema(schema).parquet(path)

    runs = Runs(fanout)
    for b in range(batches):
        own = (
            lines.filter(F.col("batch") == b).groupBy("key", "doc").agg(F.lit(1).alias("one"))
            .groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))
        )
        known = runs.all()
        if known is None:
            new = own.withColumn("has_keeper", F.lit(True))
        else:
            held = known.filter("has_keeper").select("key")
            own = written(own, "line-batch")
            fresh = own.join(held.hint("merge"), "key", "left_anti").withColumn("has_keeper", F.lit(True))
            again = own.join(held.hint("merge"), "key", "left_semi").select(
                "key", "n_docs", F.lit(None).cast(own.schema["keeper"].dataType).alias("keeper"),
                F.lit(False).alias("has_keeper"),
            )
            new = fresh.unionByName(again)
        runs.add(new)
    # Written, so that the join below shuffles both sides itself and adaptive execution can split a hot key.
    common = written(
        Runs.compacted(runs.all()).filter(F.col("n_docs") >= min_docs).select("key", "keeper"), "common-lines"
    )
    return (
        lines.join(common, "key").filter(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc").alias("__ld_doc"), F.col("mark").alias("__ld_mark")).agg(F.collect_set("pos").alias("__ld_drops"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """All rows of ``docs`` with two more columns: ``__ld_kept`` (the text that
    stays) and ``__ld_drops`` (the dropped line numbers, null if none)."""
    drops = common_lines(docs, id_col, text_col, min_chars, min_docs, batches, fanout)
    same = (F.xxhash64(text_col) == F.col("__ld_mark")) & F.col(id_col).eqNullSafe(F.col("__ld_doc"))
    joined = docs.join(drops, same, "left").drop("__ld_doc", "__ld_mark")
    lines = F.col("__ld_lines")
    # A set difference of line numbers: the time grows with the lines, not with lines times drops.
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__ld_drops")
    kept = F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    return (
        joined.withColumn("__ld_lines", F.when(F.col("__ld_drops").isNotNull(), lines_of(F.col(text_col))))
        .withColumn("__ld_kept", F.when(F.col("__ld_drops").isNull(), whole).otherwise(kept)).drop("__ld_lines")
    )


def line_digest(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays."""
    out = dedup_lines(docs.select("doc_id", "text"), **params)
    return out.select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__ld_drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.col("__ld_kept").cast("binary"), 256).alias("kept_sha256"),
    )
