"""Benchmark decontamination by a distributed positional inverted index.

Method.  Words are 64-bit hashes.  Counting the benchmark's terms over all
documents tells every test window (ten consecutive words of an item, or a
shorter item whole) its rarest terms.  Only those terms are indexed: their
postings (term, document, position) are written to a table.  Postings are
adjusted by the term's offset in the item, so occurrences of one passage meet
on one (document, item, offset) line; lines with both rarest terms of a
window are candidates.  They go to their documents, where the item's words
are compared along the line: every run of a window's length is an exact
phrase match.  ``proximity_matches`` finds the indexed terms of an item close
together in any alignment; for it a window's rarest terms are those that occur
at all, and as many as a match needs.

Scale.  Documents are read three times and shuffled once.  The benchmark is
handled in blocks of at most about ``BLOCK_WORDS`` words, so what is sent to
the tasks is bounded; a longer benchmark only takes more blocks.  Postings
carry no text and spread by (document, item, offset); a term that a third of
the documents hold is never a group.

Defined results: null texts have no words; a null or wordless item is no
item; a null item_id is listed as ``null``; items with the same id count
once; documents are told apart by id and text, so repeated rows each get
their row and a null id is like any other; an empty benchmark hits nothing;
an empty table gives an empty result.  ``decontaminate`` carries all columns
of the documents; its own start with ``__dc_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .buffers import WordHasher, slices, text_buffer
from .stage import ship_package, written

WINDOW, RAREST = 10, 2
#: Words of the benchmark that one block sends to the tasks.
BLOCK_WORDS = 200_000
#: Words between indexed terms that still count as near.
SLOP = 5

DOC_KEY = ["__dc_id", "__dc_text"]


def word_slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their word hashes and each row's first word."""
    hasher = WordHasher()
    data, offsets = text_buffer(batch.column(column))
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        words, first = hasher.words(data[part[0] : part[-1]], part - part[0])
        yield a, b, words, first


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, words): word hashes of each item that has words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, first in word_slices(batch, 1):
                packed = [words[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], names=["item", "words"]
                )

    picked = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return picked.mapInArrow(work, "item string, words binary").filter(F.length("words") > 0).distinct()


def doc_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with a key that holds for id and text, null ids too."""
    return docs.withColumns({
        DOC_KEY[0]: F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
        DOC_KEY[1]: F.xxhash64(F.col(text_col)),
    })


class Block:
    """Some items of the benchmark, on the driver (bounded by ``BLOCK_WORDS``)."""

    def __init__(self, rows: list) -> None:
        self.names = [r["item"] for r in rows]
        self.packed = [bytes(r["words"]) for r in rows]
        self.items = [np.frombuffer(w, np.uint64) for w in self.packed]
        self.vocabulary = np.unique(np.concatenate(self.items))

    def rare_places(self, counts: np.ndarray, near: int = 0) -> pd.DataFrame:
        """(term, item, place, alone): for every window that can occur, the
        places of its rarest distinct terms; ``alone`` if it has but one.  With
        ``near`` of every window, at least so many of its terms that occur."""
        found = {}
        for i, words in enumerate(self.items):
            term = np.searchsorted(self.vocabulary, words)
            seen = counts[term]
            for s in range(max(1, len(words) - WINDOW + 1)):
                window = range(s, min(s + WINDOW, len(words)))
                if near:
                    window = [p for p in window if seen[p]]
                elif min(seen[p] for p in window) == 0:
                    continue
                rare: dict[int, int] = {}
                for p in sorted(window, key=lambda p: (seen[p], p)):
                    rare.setdefault(int(term[p]), p)
                    if len(rare) == max(RAREST, near):
                        break
                for t, p in rare.items():
                    found[t, i, p] = found.get((t, i, p), False) or len(rare) == 1
        return pd.DataFrame([(*k, v) for k, v in found.items()], columns=["term", "item", "place", "alone"])


def term_counts(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each term in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, _, words, _ in word_slices(batch, 0):
                at = np.searchsorted(terms, words)
                at[at == len(terms)] = 0
                total += np.bincount(at[terms[at] == words], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    for r in docs.select(text_col).mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    return counts


def postings(keyed: DataFrame, text_col: str, terms: np.ndarray) -> DataFrame:
    """The index: (document key, term, position) of the given sorted terms."""
    shared = keyed.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for a, _, words, first in word_slices(batch, 2):
                at = np.searchsorted(wanted, words)
                at[at == len(wanted)] = 0
                hit = np.flatnonzero(wanted[at] == words)
                row = np.searchsorted(first, hit, "right") - 1
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at[hit]),
                     pa.array(hit - first[row])],
                    names=[*DOC_KEY, "term", "pos"],
                )

    return keyed.select(*DOC_KEY, text_col).mapInArrow(
        work, f"{DOC_KEY[0]} string, {DOC_KEY[1]} long, term long, pos long"
    )


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    items = written(item_words(benchmark), "benchmark-items")
    total = items.agg(F.sum(F.length("words") / 8).alias("n")).first()["n"] or 0
    n = int(-(-total // BLOCK_WORDS))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == b).collect()
        if rows:
            yield Block(sorted(rows, key=lambda r: (r["item"], bytes(r["words"]))))


def aligned_postings(keyed: DataFrame, text_col: str, block: Block, near: int = 0) -> DataFrame | None:
    """(document key, item, line, place, alone): postings of the block's rare
    places (``near``: see there), on the line (position minus place) they would match along."""
    spark = keyed.sparkSession
    places = block.rare_places(term_counts(keyed, text_col, block.vocabulary), near)
    if not len(places):
        return None
    terms = np.unique(places["term"])
    index = written(postings(keyed, text_col, block.vocabulary[terms]), "postings")
    places["term"] = np.searchsorted(terms, places["term"])
    rare = spark.createDataFrame(places, "term long, item int, place int, alone boolean")
    return index.join(F.broadcast(rare), "term").select(
        *DOC_KEY, "item", (F.col("pos") - F.col("place")).alias("line"), "place", "alone"
    )


def candidate_lines(keyed: DataFrame, text_col: str, benchmark: DataFrame) -> DataFrame | None:
    """(document key, lines): per document the (item, line, item words) whose
    rare terms are aligned."""
    spark, out = keyed.sparkSession, None
    for block in blocks(benchmark):
        aligned = aligned_postings(keyed, text_col, block)
        if aligned is None:
            continue
        lines = aligned.groupBy(*DOC_KEY, "item", "line").agg(
            F.max("alone").alias("alone"), F.min("place").alias("lo"), F.max("place").alias("hi")
        ).filter("alone OR hi > lo")
        names = spark.createDataFrame(
            [(i, n, bytearray(w)) for i, (n, w) in enumerate(zip(block.names, block.packed, strict=True))],
            "item int, name string, words binary",
        )
        lines = written(
            lines.join(F.broadcast(names), "item").select(*DOC_KEY, F.struct("name", "line", "words").alias("l")), "lines"
        )
        out = lines if out is None else out.unionByName(lines)
    return None if out is None else out.groupBy(*DOC_KEY).agg(F.collect_list("l").alias("__dc_lines"))


def phrase_hits(words: np.ndarray, lines: list[dict]) -> tuple[np.ndarray, list[str]]:
    """Which words of a document are hit, and the items that occur in it."""
    hit, items = np.zeros(len(words) + 1, np.int64), set()
    for l in lines:
        item, d = np.frombuffer(l["words"], np.uint64), l["line"]
        size = min(WINDOW, len(item))
        lo, hi = max(0, -d), min(len(item), len(words) - d)
        if hi - lo < size:
            continue
        same = np.r_[0, np.cumsum(item[lo:hi] == words[lo + d : hi + d])]
        starts = np.flatnonzero(same[size:] - same[:-size] == size) + lo + d
        if len(starts):
            items.add(l["name"])
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + size, -1)
    return np.cumsum(hit)[:-1] > 0, sorted(items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__dc_words``, ``__dc_hit`` (counts of words and of hit
    words), ``__dc_items`` (ids) and ``__dc_spans`` (hit word ranges)."""
    ship_package(docs.sparkSession)
    keyed = doc_keys(docs, id_col, text_col)
    lines = candidate_lines(keyed, text_col, benchmark)
    kind = "array<struct<name:string,line:bigint,words:binary>>"
    if lines is None:
        joined = keyed.withColumn("__dc_lines", F.lit(None).cast(kind))
    else:
        joined = keyed.join(lines, DOC_KEY, "left")
    joined = joined.select(*docs.columns, "__dc_lines")
    at = docs.columns.index(text_col)
    schema = StructType([
        *docs.schema.fields, StructField("__dc_words", LongType()), StructField("__dc_hit", LongType()),
        StructField("__dc_items", ArrayType(StringType())),
        StructField("__dc_spans", ArrayType(StructType().add("start", "integer").add("end", "integer"))),
    ])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            for a, b, words, first in word_slices(batch, at):
                hits, items, spans = [], [], []
                for i, lines in enumerate(found.slice(a, b - a)):
                    own = words[first[i] : first[i + 1]]
                    hit, names = phrase_hits(own, lines.as_py()) if lines.is_valid else (np.zeros(0, bool), [])
                    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                    hits.append(int(hit.sum()))
                    items.append(names)
                    spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns[:-1], pa.array(np.diff(first)), pa.array(hits, pa.int64()),
                     pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
                    names=schema.names,
                )

    return joined.mapInArrow(work, schema)


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id", F.col("__dc_words").alias("n_words"), F.col("__dc_hit").alias("n_hit"),
        F.size("__dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__dc_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("__dc_hit") > 0).alias("contaminated"),
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, min_places: int, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(document key, item, start, places): where at least ``min_places``
    indexed places of an item lie on lines at most ``slop`` apart."""
    ship_package(docs.sparkSession)
    keyed, out = doc_keys(docs, id_col, text_col), None
    for block in blocks(benchmark):
        aligned = aligned_postings(keyed, text_col, block, max(1, min_places))
        if aligned is None:
            continue
        own = Window.partitionBy(*DOC_KEY, "item").orderBy("line", "place")
        lines = aligned.withColumn("gap", F.col("line") - F.lag("line").over(own))
        group = F.sum(F.when(F.col("gap") > slop, 1).otherwise(0)).over(own)
        near = (
            lines.withColumn("group", group).groupBy(*DOC_KEY, "item", "group")
            .agg(F.min(F.col("line") + F.col("place")).alias("start"), F.countDistinct("place").alias("places"))
            .filter(F.col("places") >= min_places)
        )
        names = docs.sparkSession.createDataFrame(list(enumerate(block.names)), "item int, name string")
        near = near.join(F.broadcast(names), "item").select(*DOC_KEY, F.col("name").alias("item"), "start", "places")
        out = near if out is None else out.unionByName(near)
    if out is None:
        schema = f"{DOC_KEY[0]} string, {DOC_KEY[1]} long, item string, start long, places long"
        return docs.sparkSession.createDataFrame([], schema)
    return out
