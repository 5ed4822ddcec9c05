"""N-gram Jaccard join by chosen paths.

Method.  A document is the set of its 5-word shingles; equal sets are one
node of the join.  Each set has ``COORDS`` min-hash tokens, every one a random
token of the set, shared by two sets with the probability of their Jaccard
similarity.  A run splits all sets by one or two sampled tokens, and splits
buckets that are still large again and again, by tokens chosen from the
bucket's own path (1 / 0.8 tokens expected, so a pair at the threshold keeps
one common path on average).  Small buckets are compared by brute force on
one byte per token; what looks similar enough is tied together.  ``RUNS``
independent runs bring the recall of pairs at the threshold over ``RECALL``.
Groups of tied sets are then compared pair by pair on their exact shingle
sets, so no reported link is an estimate, and links inside a group that no
bucket showed are found too.

Scale.  Only (path, set id, 64 signature bytes) rows are shuffled, and only
those in buckets of two or more are compared.  Buckets that stay large after
``MAX_DEPTH`` splits (thousands of near copies) are cut into chunks of about
``BLOCK_ROWS / 2`` sets, and every two chunks are compared as a bucket of
their own: all pairs of the bucket meet, in many tasks.  Tied groups are
compared in blocks of at most ``BLOCK_ROWS`` sets in the same way.  Buckets and blocks report a spanning star and a
count per set, never all pairs.

Defined results: A-Z is lower-cased and words are runs of letters, digits and
non-ASCII characters; a text of one to four words is one shingle of its own;
null, empty and wordless texts are in no group (own class, no link); copies
are linked; repeated rows count as copies; a null id stays null and never
names a class that has another id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import WordHasher, mix, slices, text_buffer
from .components import components
from .stage import ship_package, written

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99
COORDS, RUNS, MAX_DEPTH = 64, 8, 4
#: Sets compared by brute force in a bucket, and in a block of a tied group.
BUCKET, BLOCK_ROWS, BLOCK_BYTES = 512, 2048, 16 << 20
#: Equal signature bytes (of 64) that tie two sets: at similarity 0.8 fewer
#: has a probability under 0.0005.
TIED = 40
#: Rows (signatures or texts) that one task of a comparison holds.
PACK_ROWS, PACK_BYTES = 20_000, 8 << 20
STRIP_ROWS = 256

_STEP = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in order, and each row's first one plus the end."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, n > 0)
    at = np.r_[0, np.cumsum(count)]
    if not at[-1]:
        return np.empty(0, np.uint64), at
    place = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    end = np.repeat(first[1:], count)
    out = np.repeat(np.minimum(n, size), count).astype(np.uint64)
    for j in range(size):
        word = words[np.minimum(place + j, len(words) - 1)]
        out = out * _STEP + np.where(place + j < end, word, np.uint64(0))
    return mix(out), at


def sets_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, sid, nodes, sig): per row the text's hash, the id of its
    shingle set (null without words), the buckets of the first split of every
    run, and the signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                found, at = shingles(*hasher.words(data[part[0] : part[-1]], part - part[0]))
                rows = np.flatnonzero(np.diff(at))
                low = np.zeros((len(rows), COORDS), np.uint32)
                for k in range(COORDS if len(rows) else 0):
                    low[:, k] = np.minimum.reduceat((found * _FACTORS[k]) >> np.uint64(32), at[rows])
                sid, sig, nodes = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                for r, mins in zip(rows, low, strict=True):
                    own = np.unique(found[at[r] : at[r + 1]])
                    sid[r] = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                    sig[r] = mins.astype(np.uint8).tobytes()
                    nodes[r] = _roots(mins)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sid, pa.int64()),
                     pa.array(nodes, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc", "mark", "sid", "nodes", "sig"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return picked.mapInArrow(work, f"doc {kind}, mark long, sid long, nodes array<long>, sig binary")


def _roots(mins: np.ndarray) -> list[int]:
    """Buckets of the root split: one sampled token a run, two in every fourth."""
    out = []
    for run in range(RUNS):
        for k in range(2 if run % 4 == 0 else 1):
            c = run * (COORDS // RUNS) + k
            out.append((int(mins[c]) | (run * COORDS + c) << 32))
    return out


def split(big: DataFrame) -> DataFrame:
    """Children of large buckets: one or two tokens chosen by the path."""
    coord = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDS)).cast("int")
    chosen = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(4)) == 0, F.array(coord(1), coord(2))).otherwise(F.array(coord(1)))
    return big.withColumn("c", F.explode(F.array_distinct(chosen))).select(
        F.xxhash64("node", "c", F.expr("substring(sig, c + 1, 1)")).alias("node"), "sid", "sig"
    )


def stars(index: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index each index is connected to over the pairs (a, b)."""
    root = index.copy()
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def compare_buckets(table: pa.Table) -> pa.Table:
    """Brute force in every bucket: each set's tie to the smallest set it is
    connected to in the bucket."""
    node = table.column("node").to_numpy()
    sid = table.column("sid").to_numpy()
    order = np.lexsort((sid, node))
    node, sid = node[order], sid[order]
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDS)[order]
    root, step = np.arange(len(node)), 1
    alive = np.arange(len(node))
    while True:
        alive = alive[alive + step < len(node)]
        alive = alive[node[alive] == node[alive + step]]
        if not len(alive):
            break
        for part in np.array_split(alive, -(-len(alive) // 65536)):
            tied = part[(sig[part] == sig[part + step]).sum(1) >= TIED]
            a, b = root[tied], root[tied + step]
            apart = a != b  # pairs are joined at once: near copies make many, but few join anything new
            if apart.any():
                root = stars(root, a[apart], b[apart])
        step += 1
    edge = np.flatnonzero(root != np.arange(len(node)))
    edge = edge[sid[edge] != sid[root[edge]]]
    return pa.table({"u": sid[edge], "v": sid[root[edge]]})


def chunk_pairs(big: DataFrame) -> DataFrame:
    """Buckets too large for one task as buckets of two chunks each, every
    chunk with every other, so that all sets of a bucket still meet."""
    chunks = F.ceil(F.col("n") * 2 / BLOCK_ROWS)
    dealt = big.withColumn("own", F.pmod(F.xxhash64("sid", "node"), chunks))
    others = F.sequence(F.lit(0).cast("long"), chunks - 1)
    met = dealt.withColumn("other", F.explode(F.when(chunks == 1, others).otherwise(F.array_remove(others, F.col("own")))))
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return met.select(pair.alias("node"), "sid", "sig")


def ties(nodes: DataFrame) -> DataFrame:
    """(u, v): sets tied by some bucket of some run."""
    level, compared, spark = nodes, None, nodes.sparkSession
    for depth in range(MAX_DEPTH + 1):
        counts = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        level = written(level.join(counts, "node"), f"buckets-{depth}")
        small = level.filter(F.col("n") <= BUCKET).select("node", "sid", "sig")
        big = level.filter(F.col("n") > BUCKET)
        if depth == MAX_DEPTH:  # near copies that agree on every path
            small = small.unionByName(chunk_pairs(big))
        compared = small if compared is None else compared.unionByName(small)
        if depth == MAX_DEPTH or big.isEmpty():
            break
        level = written(split(big), f"split-{depth}")
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-compared.count() // PACK_ROWS))
    return (
        compared.withColumn("pack", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(packs)))
        .groupBy("pack").applyInArrow(compare_buckets, "u long, v long").distinct()
    )


def exact_links(table: pa.Table) -> pa.Table:
    """Per set of a block: its links, the documents behind them, and the
    smallest set it is linked with in the block.  ``part`` is -1 where all
    pairs count, else 0 or 1 and pairs across count (and within 0 if alone)."""
    table = table.sort_by([("comp", "ascending"), ("sid", "ascending")])
    comp, sid = table.column("comp").to_numpy(), table.column("sid").to_numpy()
    side, copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
    data, offsets = text_buffer(table.column("text"))
    hasher, sets = WordHasher(), []
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        found, at = shingles(*hasher.words(data[part[0] : part[-1]], part - part[0]))
        sets += [np.unique(found[at[i] : at[i + 1]]) for i in range(b - a)]
    links, docs, root = np.zeros(len(sid), np.int64), np.zeros(len(sid), np.int64), np.arange(len(sid))
    cuts = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        near = similar(sets[a:b])
        if (side[a:b] >= 0).any():  # a pair of blocks: only pairs across are this group's
            near &= side[a:b, None] != side[None, a:b]
        for s in strips(b - a):
            links[a:b][s] = near[s].sum(1)
            docs[a:b][s] = near[s] @ copies[a:b]
        root[a:b] = a + smallest_linked(near)
    return pa.table({"sid": sid, "links": links, "docs": docs, "root": sid[root]})


def strips(n: int) -> list[slice]:
    """Rows of an n x n comparison that are handled at once."""
    return [slice(s, s + STRIP_ROWS) for s in range(0, n, STRIP_ROWS)]


def smallest_linked(near: np.ndarray) -> np.ndarray:
    """Smallest index each index is connected to in a symmetric matrix."""
    root = np.arange(len(near))
    while True:
        before = root.copy()
        for s in strips(len(near)):
            root[s] = np.minimum(root[s], np.where(near[s], root, len(near)).min(1))
        root = root[root]
        if np.array_equal(before, root):
            return root


def similar(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sets have the Jaccard similarity, the diagonal not."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(seen > 1)
    column = np.full(len(seen), -1)
    column[shared] = np.arange(len(shared))
    column = column[token]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, (4 << 20) // len(sets))
    for a in range(0, len(shared), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(sets), min(width, len(shared) - a)), np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        for s in strips(len(sets)):
            both[s] += m[s] @ m.T
    # In whole numbers: shared / (sizes - shared) >= 4/5 without rounding.
    least, near = round(threshold * 1000), np.zeros(both.shape, bool)
    for s in strips(len(sets)):
        near[s] = np.rint(both[s]).astype(np.int64) * (1000 + least) >= least * (size[s, None] + size)
    np.fill_diagonal(near, False)
    return near


def link_sets(docs: DataFrame, rows: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sid, links, docs, root) of the sets that any bucket tied."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = components(ties(sets.select(F.explode("nodes").alias("node"), "sid", "sig")))
    groups = tied.select(F.col("u").alias("sid"), F.col("root").alias("comp"))
    groups = groups.unionByName(tied.select(F.col("root").alias("sid"), F.col("root").alias("comp")).distinct())
    members = groups.join(sets.select("sid", "copies", "doc", "mark"), "sid")
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    same = members["doc"].eqNullSafe(texts["doc"]) & (members["mark"] == texts["mark"])
    members = written(
        texts.join(members, same).select("comp", "sid", "copies", "text").dropDuplicates(["sid"]), "tied-texts"
    )
    size = members.groupBy("comp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("blocks")
    )
    total = members.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packs = max(parts, -(-total // PACK_BYTES))
    # Groups of one block are packed by hash; of more, every pair of blocks is a pack of its own.
    block = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    placed = members.join(size, "comp").withColumn("block", block).withColumn(
        "other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    alone = (F.col("blocks") == 1) | (F.col("block") == F.col("other"))
    pack = F.when(F.col("blocks") == 1, F.concat(F.lit("p"), F.pmod(F.xxhash64("comp"), F.lit(packs)))).otherwise(
        F.concat_ws(" ", "comp", F.least("block", "other"), F.greatest("block", "other"))
    )
    side = F.when(alone, -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    found = written(
        placed.select(pack.alias("pack"), "comp", "sid", "copies", side.cast("int").alias("side"), "text")
        .groupBy("pack").applyInArrow(exact_links, "sid long, links long, docs long, root long"),
        "set-links",
    )
    counts = found.groupBy("sid").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    roots = components(found.filter("sid <> root").select(F.col("sid").alias("u"), F.col("root").alias("v")))
    return counts.join(roots.withColumnRenamed("u", "sid"), "sid", "left").select(
        "sid", "links", "docs", F.coalesce("root", "sid").alias("root")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, class_id, n_links, n_text_links, first, grouped): one row per row of
    ``docs``.  ``mark`` is xxhash64 of the text; ``class_id`` the smallest id
    of the documents connected by links; ``n_links`` the documents at the
    threshold, copies included; ``n_text_links`` the other shingle sets;
    ``first`` whether (doc, mark) is the class's smallest; ``grouped`` whether
    the text has words and so can be in a group."""
    ship_package(docs.sparkSession)
    rows = written(sets_table(docs, id_col, text_col), "shingle-sets")
    sets = written(
        rows.filter("sid IS NOT NULL").groupBy("sid").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "mark", "nodes", "sig")).alias("r")
        ).select("sid", "copies", "r.*"), "sets",
    )
    linked = written(link_sets(docs, rows, sets, id_col, text_col), "linked-sets")
    labels = sets.select("sid", "copies", "doc", "mark").join(linked, "sid", "left").select(
        "sid", F.coalesce("root", "sid").alias("root"), F.coalesce("links", F.lit(0)).alias("n_text_links"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "doc", "mark",
    )
    classes = labels.groupBy("root").agg(
        F.min("doc").alias("class_id"), F.min(F.struct("doc", "mark")).alias("head")
    )
    labels = labels.drop("doc", "mark").join(classes, "root").select("sid", "class_id", "head", "n_links", "n_text_links")
    out = rows.select("doc", "mark", "sid").join(labels, "sid", "left")
    return out.select(
        "doc", "mark",
        F.when(F.col("sid").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("n_text_links", F.lit(0).cast("long")).alias("n_text_links"),
        (F.col("sid").isNull() | F.struct("doc", "mark").eqNullSafe(F.col("head"))).alias("first"),
        F.col("sid").isNotNull().alias("grouped"),
    )


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links."""
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "class_id", "n_links", "n_text_links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate class: the document
    with the smallest id (of rows with its id and text the smallest in all
    other columns).  Wordless texts all stay."""
    keys = ["__nd_id", "__nd_mark"]
    named = lambda c: F.coalesce(c.cast("string"), F.lit("null")).alias(keys[0])
    kept = near_duplicates(docs.select(id_col, text_col), id_col, text_col).filter("first").select(
        named(F.col("doc")), F.col("mark").alias(keys[1]), "grouped"
    ).distinct()
    marked = docs.select("*", named(F.col(id_col)), F.xxhash64(text_col).alias(keys[1]))
    same = Window.partitionBy(*keys).orderBy(*(f"`{c}`" for c in docs.columns if c != text_col))
    return (
        marked.join(kept.hint("merge"), keys).withColumn("__nd_row", F.row_number().over(same))
        .filter("NOT grouped OR __nd_row = 1").select(*docs.columns)
    )
