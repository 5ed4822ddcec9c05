"""Suffix-array dedup: threshold-bounded interval expansion.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere
in the corpus is removed.

Method.  Equal strings of that length share their smallest gram (the
``GRAM``-byte window with the smallest hash), at the same offset.  Every
window start of a text belongs to one such gram; grams that occur once end
there.  Grams whose surroundings (all bytes of their windows) are equal
everywhere are repeats as they stand.  The others make buckets, each with the
distinct surroundings of one gram.  In a bucket the surroundings are put in
the suffix order of what follows the gram, with common prefix lengths of
neighbours; an interval of that order is then extended backward, byte by byte
of the column before it (the Burrows-Wheeler column of that step), breadth
first over all intervals, while the part needed after the gram shrinks by one
byte.  Intervals left with one member are dropped, and an extension stops as
soon as gram, left and right part make up ``LENGTH``: longer matches are
never computed.  What stays in one interval is a repeated string.

Scale.  Only (gram, surroundings, text, position) hashes of all texts are
shuffled, about one per ``LENGTH - GRAM`` / 2 bytes.  Texts travel once by
their hash; the exchange serves both the surroundings and the final cut.
Exact copies of a text are one text from the start, and copies of a passage
collapse by the hash of their surroundings, so buckets hold distinct strings
only.  A gram with more than ``BUCKET`` of them (a line in a third of all
documents) is split: its windows are dealt by offset into cells keyed by all
bytes that the cell's windows share.  Beyond ``BUCKET`` times the largest of
``CELLS`` a cell is one window, its key the whole string, and keys are only
counted.  Counts are aggregated before they are shuffled, and joined back so
that a hot gram can be split; buckets are packed into tasks by bytes.

Defined results: null and empty texts have no bytes and no spans; texts are
UTF-8 bytes, matches never cross texts; two documents with the same text of
at least ``LENGTH`` bytes lose it whole, and so do repeated rows; texts
shorter than that lose nothing; an empty table gives an empty result; extra
columns are carried by ``remove_repeats`` (its own start with ``__sa_``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from .buffers import mix, slices, text_buffer
from .stage import ship_package, written

LENGTH, GRAM = 200, 64
#: Offsets that a window can have from its gram.
OFFSETS = LENGTH - GRAM + 1
#: Distinct surroundings of a gram that are one bucket; for up to so many
#: times more, cells have that many offsets, beyond that one.
BUCKET, CELLS = 4096, ((1, OFFSETS), (8, 32), (64, 8))
PACK_BYTES = 8 << 20
#: Bytes handled at once, for the cache; a longer text is cut into pieces
#: that overlap by a window, and positions in a piece fit ``POSITION`` bits.
SLICE, PIECE, POSITION = 1 << 17, 1 << 23, 24

_STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Roller:
    """Hashes of any byte range, from prefix sums of byte values times powers."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(data) >= len(self.up):
            n = 1 << len(data).bit_length()
            powers = []
            for base in (_STEP, pow(_STEP, -1, 1 << 64)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                powers.append(np.multiply.accumulate(p))
            self.up, self.down = powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        own = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(own + (np.asarray(end) - start).astype(np.uint64))


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n])


def grams(data: np.ndarray, offsets: np.ndarray, roller: Roller) -> tuple[np.ndarray, ...]:
    """(row, gram hash, hash of surroundings, gram position, first and last
    window start) of all grams of some texts, positions within their text."""
    if len(data) < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    roller.load(data)
    at = np.arange(len(data) - GRAM + 1)
    value = roller.hash(at, at + GRAM)
    low = np.uint64((1 << POSITION) - 1)
    best = smallest(value & ~low | at.astype(np.uint64), OFFSETS)
    chosen = (best & low).astype(np.int64)  # the gram of the window that starts here, the first of equal ones
    row = np.searchsorted(offsets, np.arange(len(chosen)), "right") - 1
    inside = np.arange(len(chosen)) + LENGTH <= offsets[row + 1]
    edge = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])])
    first, last = edge, np.r_[edge[1:], len(chosen)] - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    gram, row = chosen[first], row[first]
    around = roller.hash(first, last + LENGTH)
    begin = offsets[row]
    return row, value[gram], around, gram - begin, first - begin, last - begin


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, tk, n): a text is known by its hash and its length in bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tk"), F.octet_length(text).alias("n")
    )


def gram_table(texts: DataFrame) -> DataFrame:
    """(h, ctx, tk, n, id, places, lo, hi) of all texts long enough, copies in a task once."""
    kind = texts.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, seen = Roller(), set()
        for batch in batches:
            new = []
            for i, k in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, SLICE):
                size = offsets[b] - offsets[a]
                if b - a > 1 or size <= PIECE:
                    found = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], roller)
                else:  # one very long text, in pieces that share no window
                    parts = []
                    for s in range(0, size - LENGTH + 1, PIECE):
                        piece = data[offsets[a] + s : min(offsets[a] + s + PIECE + LENGTH - 1, offsets[b])]
                        p = grams(piece, np.array([0, len(piece)]), roller)
                        parts.append((*p[:3], *(x + s for x in p[3:])))
                    found = tuple(map(np.concatenate, zip(*parts, strict=True)))
                row, h, ctx, pos, lo, hi = found
                lo, hi = (pos - hi).astype(np.int16), (pos - lo).astype(np.int16)
                # A text that goes round in circles has the same gram and surroundings many times: one row.
                order = np.lexsort((pos, lo, hi, ctx, h, row))
                row, h, ctx, pos, lo, hi = (x[order] for x in (row, h, ctx, pos, lo, hi))
                if len(row):
                    new = np.any([x[1:] != x[:-1] for x in (row, h, ctx, lo, hi)], axis=0)
                    head = np.flatnonzero(np.r_[True, new])
                else:
                    head = np.empty(0, np.int64)
                places = pa.ListArray.from_arrays(
                    pa.array(np.r_[head, len(pos)].astype(np.int32)), pa.array(pos.astype(np.int32))
                )
                rows = pa.array(row[head] + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[head].view(np.int64)), pa.array(ctx[head].view(np.int64)), batch.column(2).take(rows),
                     batch.column(3).take(rows), batch.column(0).take(rows), places, pa.array(lo[head]), pa.array(hi[head])],
                    names=["h", "ctx", "tk", "n", "id", "places", "lo", "hi"],
                )

    return texts.select("id", "text", "tk", "n").filter(F.col("n") >= LENGTH).mapInArrow(
        work, f"h long, ctx long, tk long, n int, id {kind}, places array<int>, lo short, hi short"
    )


def cell_width(members: int, bucket: int = BUCKET) -> int:
    return next((w for times, w in CELLS if members <= bucket * times), 1)


def cells(text: bytes, h: int, pos: int, lo: int, hi: int, members: int, bucket: int = BUCKET) -> Iterator[tuple]:
    """(key, first offset, last offset, own range, left part reversed, right
    part) of each cell of a gram's windows; offsets are bytes before the gram."""
    width = cell_width(members, bucket)
    for c in range(lo // width, hi // width + 1):
        olo, ohi = c * width, min(c * width + width, OFFSETS) - 1
        mlo, mhi = max(lo, olo), min(hi, ohi)
        core = text[pos - olo : pos - ohi + LENGTH]
        key = hashlib.blake2b(core, digest_size=8, person=f"{olo}-{ohi}".encode(), key=h.to_bytes(8, "little", signed=True))
        yield (
            int.from_bytes(key.digest(), "little", signed=True), ohi - olo, mlo - olo, mhi - olo, olo,
            text[pos - mhi : pos - olo][::-1], text[pos - ohi + LENGTH : pos - mlo + LENGTH],
        )


def matrix(parts: list[bytes]) -> np.ndarray:
    width = -(-max([1, *map(len, parts)]) // 8) * 8
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)


def order_of(group: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, bytes), and each one's common prefix with the one before (-1: another group)."""
    words = m.view(">u8").astype(np.uint64)
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group))
    s, g = m[order], group[order]
    lcp = np.full(len(order), -1)
    if len(order) > 1:
        other = s[1:] != s[:-1]
        lcp[1:] = np.where(other.any(1), other.argmax(1), m.shape[1])
        lcp[1:][g[1:] != g[:-1]] = -1
    return order, lcp


def expand(table: pa.Table) -> pa.Table:
    """Backward extension in all buckets of a pack: (h, ctx, a, b), runs of
    offsets whose windows another member of the bucket has too."""
    key, ctx = table.column("key").to_numpy(), table.column("ctx").to_numpy()
    _, own = np.unique(np.stack([key, ctx], 1), axis=0, return_index=True)
    table, key, ctx = table.take(pa.array(own)), key[own], ctx[own]
    right, left = (matrix(table.column(c).to_pylist()) for c in ("right", "left"))
    span, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("span", "lo", "hi"))
    _, group = np.unique(key, return_inverse=True)
    # How far each member agrees with its nearest ones on either side bounds its offsets.
    reach = []
    for m in (left, right):
        order, lcp = order_of(group, m)
        far = np.empty(len(order), np.int64)
        far[order] = np.maximum(lcp, np.r_[lcp[1:], -1])
        reach.append(far)
    lo, hi = np.maximum(lo, span - reach[1]), np.minimum(hi, reach[0])
    live = np.flatnonzero((lo <= hi) & (reach[0] >= 0))
    order, lcp = order_of(group[live], right[live])  # the suffix order
    live = live[order]
    cls, need, found = group[live], span[live], []
    rank = np.arange(len(live))
    for d in range(int(need.max()) + 1 if len(live) else 0):
        same_right = np.cumsum(lcp < need - d)  # agree on the bytes still needed after the gram
        ready = rank[(lo[live[rank]] <= d) & (d <= hi[live[rank]])]
        c, r = cls[ready], same_right[ready]
        by = np.argsort(c, kind="stable")  # intervals; members stay in suffix order
        pair = (c[by][1:] == c[by][:-1]) & (r[by][1:] == r[by][:-1])
        hit = ready[by[(np.r_[pair, False] | np.r_[False, pair])[: len(ready)]]]
        found.append(np.stack([live[hit], np.full(len(hit), d)], 1))
        # One byte further back: an interval splits by the byte before it.
        rank = rank[hi[live[rank]] > d]
        if not len(rank):
            break
        _, new, size = np.unique(cls[rank] << 8 | left[live[rank], d], return_inverse=True, return_counts=True)
        cls[rank] = new
        rank = rank[size[new] > 1]
    out = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    out = out[~table.column("whole").to_numpy()[out[:, 0]]]  # known to be repeated as they stand
    out = out[np.lexsort((out[:, 1], out[:, 0]))]
    head = np.r_[True, (np.diff(out[:, 0]) != 0) | (np.diff(out[:, 1]) != 1)][: len(out)]
    first = np.flatnonzero(head)
    last = np.r_[first[1:], len(out)][: len(first)] - 1
    who, base = out[first, 0], table.column("olo").to_numpy().astype(np.int64)
    return pa.table({
        "h": table.column("h").to_numpy()[who], "ctx": ctx[who],
        "a": (out[first, 1] + base[who]).astype(np.int32), "b": (out[last, 1] + base[who]).astype(np.int32),
    })


def repeated_grams(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``kept``: the gram rows of grams that occur more than once, with
    ``mixed`` (their surroundings differ) and ``members`` (at least the number
    of distinct surroundings); ``contexts``: one row per gram and surroundings
    with its smallest occurrence and ``whole`` (it occurs more than once)."""
    found = written(gram_table(texts), "grams")
    # Written, so that the join shuffles both sides itself and adaptive execution can split a hot gram.
    seen = written(
        found.groupBy("h").agg(
            (F.min("ctx") != F.max("ctx")).alias("mixed"), F.count(F.lit(1)).alias("members"),
            F.sum(F.size("places")).alias("occurrences"),
        ).filter("occurrences > 1").drop("occurrences"), "gram-counts",
    )
    kept = written(found.join(seen, "h"), "repeated-grams")
    ends = kept.groupBy("h", "ctx", "mixed", "members").agg(
        F.min(F.struct("tk", "n", "places", "id", "lo", "hi")).alias("one"),
        F.max(F.struct("tk", "n", "places")).alias("last"), F.max(F.size("places")).alias("most"),
    )
    whole = (F.struct("one.tk", "one.n", "one.places") != F.col("last")) | (F.col("most") > 1)
    return kept, written(ends.withColumn("whole", whole).select("h", "ctx", "mixed", "members", "one.*", "whole"), "gram-contexts")


def surroundings(texts: DataFrame, contexts: DataFrame, bucket: int) -> DataFrame:
    """The cells of the given surroundings, from the texts of their occurrences."""
    asked = contexts.groupBy("tk", "n").agg(
        F.collect_list(F.struct("h", "ctx", "whole", "id", F.col("places")[0].alias("pos"), "lo", "hi", "members")).alias("asked")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "ctx", "whole", "key", "span", "lo", "hi", "olo", "left", "right"]
        kinds = [pa.int64()] * 2 + [pa.bool_(), pa.int64()] + [pa.int32()] * 4 + [pa.binary()] * 2
        for batch in batches:
            for i in range(batch.num_rows):
                me = batch.column(0)[i].as_py()
                mine = [x for x in batch.column(2)[i].as_py() if x["id"] == me]
                if not mine:
                    continue
                text = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                rows = [
                    (x["h"], x["ctx"], x["whole"], *cell) for x in mine
                    for cell in cells(text, x["h"], x["pos"], x["lo"], x["hi"], x["members"], bucket)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
                )

    return texts.join(asked.hint("merge"), ["tk", "n"]).select("id", "text", "asked").mapInArrow(
        work, "h long, ctx long, whole boolean, key long, span int, lo int, hi int, olo int, left binary, right binary"
    )


def repeat_spans(texts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(tk, n, spans): byte ranges to remove of every text that has some."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept, contexts = repeated_grams(texts)
    mixed = contexts.filter("mixed")
    packs = max(parts, -(-mixed.count() * 2 * OFFSETS // PACK_BYTES))
    shared = F.col("members") > bucket * CELLS[-1][0]
    expanded = (
        surroundings(texts, mixed.filter(~shared), bucket).groupBy(F.pmod(F.xxhash64("key"), F.lit(packs)).alias("pack"))
        .applyInArrow(expand, "h long, ctx long, a int, b int")
    )
    # Cells of one window need no extension: counting their keys, before the shuffle too, tells which occur twice.
    singles = written(surroundings(texts, mixed.filter(shared), bucket).select("h", "ctx", "whole", "key", "olo"), "windows")
    twice = written(
        singles.groupBy("h", "olo", "key").agg((F.min("ctx") != F.max("ctx")).alias("twice")).filter("twice"), "repeated-windows"
    )
    counted = singles.filter("NOT whole").join(twice, ["h", "olo", "key"]).select(
        "h", "ctx", F.col("olo").alias("a"), F.col("olo").alias("b")
    ).distinct()
    whole = contexts.filter("whole").select("h", "ctx", F.col("lo").cast("int").alias("a"), F.col("hi").cast("int").alias("b"))
    ranges = whole.unionByName(expanded).unionByName(counted)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")).alias("s")
    pos: Column = F.col("pos")
    inside = kept.select("h", "ctx", "tk", "n", "places").join(ranges, ["h", "ctx"]).withColumn("pos", F.explode("places")).select(
        "tk", "n", span(pos - F.col("b"), pos - F.col("a") + LENGTH)
    )
    copies = texts.filter(F.col("n") >= LENGTH).groupBy("tk", "n").count().filter("count > 1").select(
        "tk", "n", span(F.lit(0), F.col("n"))
    )
    return inside.unionByName(copies).groupBy("tk", "n").agg(F.collect_set("s").alias("spans"))


def merged_spans(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, __sa_spans, __sa_kept): per row the removed byte ranges and the
    bytes that stay (not always whole characters)."""
    ship_package(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    joined = texts.join(repeat_spans(texts, bucket).hint("merge"), ["tk", "n"], "left").select("id", "text", "spans")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                part, spans, kept = batch.slice(a, b - a), [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw, at, rest, own = text.encode("utf-8", "surrogatepass"), 0, [], merged_spans(found or [])
                    for s, e in own:
                        rest.append(raw[at:s])
                        at = e
                    rest.append(raw[at:])
                    spans.append([{"start": s, "end": e} for s, e in own])
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(spans, span), pa.array(kept, pa.binary())],
                    names=[id_col, "__sa_spans", "__sa_kept"],
                )

    schema = StructType([
        docs.schema[id_col],
        StructField("__sa_spans", ArrayType(StructType().add("start", "integer").add("end", "integer"))),
        StructField("__sa_kept", BinaryType()),
    ])
    return joined.mapInArrow(work, schema)


def repeat_digest(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs.select("doc_id", "text"), bucket=bucket)
    removed = F.aggregate("__sa_spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"]))
    return out.select(
        "doc_id", (F.octet_length("__sa_kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
        F.size("__sa_spans").cast("long").alias("n_spans"), F.sha2("__sa_kept", 256).alias("kept_sha256"),
    )
