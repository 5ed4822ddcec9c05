"""Conversation prefix trie by the Euler-tour technique.

Method.  Every distinct sequence of first turns is a node.  A node is named by
its depth and its smallest member, and found by the sum of hashes of (place,
role, text) over its turns, a running sum over sorted turns.  Sorting nodes
below their parents gives children, siblings and parents; each node becomes
an enter and an exit arc, linked to the next arc of the tour: enter leads to
the first child or the own exit, exit to the next sibling or the parent's
exit.  The tour is list-ranked (``listrank``), and leaves and savings of a
subtree are differences of prefix sums over the arcs in tour order.

Scale.  Turns, siblings and arcs are scanned in sorted order by range
(``scan``), so a conversation of very many turns, or a node with very many
children or members, is spread over tasks; members are counted by partial
aggregation.  Only turn digests are shuffled, no texts.  The one sequential
piece is the SHA-256 of a node's ends: they arrive as ready chunks and are
hashed as a stream.  Each step is written to the shared folder.

Defined results: rows without a conv_id belong to no conversation; a null
role or text is empty; turns with an equal (or null) turn number are ordered
by the first 64 code points of role, then of text, then by their digest;
repeated rows are turns of their own.  Texts may be very long (they are
hashed where they are read).  Extra columns are not read.  An empty table
gives an empty result, conversations without turns only the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listrank import BASE, list_ranks
from .scan import sorted_scan
from .stage import ship_package, written

#: The contract's rebuilding: heads of fewer than HEAD turns, shared by
#: conversations of one block of BLOCK ids.
HEAD, BLOCK = 6, 100
#: Copies of a shared conversation's length, by which its turns are dealt.
SALTS = 16
#: Bytes of a chunk of member ids.
CHUNK = 1 << 16


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, chars): the turns in order, texts as digests."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.left(role, F.lit(64)).alias("role64"),
        F.left(text, F.lit(64)).alias("text64"), turn_key(role, text).alias("turn_key"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ["turn", "role64", "text64", "turn_key"]
    return sorted_scan(rows, ["conv_id"], order, ["conv_id", "turn_key", "chars"]).select(
        "conv_id", "pos", "turn_key", "chars"
    )


def turn_key(role: Column, text: Column) -> Column:
    """128-bit digest of a turn."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def rebuilt(turns: DataFrame) -> DataFrame:
    """The contract's conversations, as (conv_id, pos, turn_key, chars); the
    lengths (conv_id, size) include those that end without turns."""
    sizes = written(turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("size")), "conversation-sizes")
    base = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base")
    shared = sizes.filter(F.col("conv_id") % BLOCK == 0)
    heads = turns.filter((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < HEAD - 1)).withColumnRenamed("conv_id", "base")
    own_head = sizes.select("conv_id", base, _head("conv_id").alias("h"))
    first = own_head.join(heads, "base").filter("pos < h").select("conv_id", "pos", "turn_key", "chars")
    known = shared.select(
        F.col("conv_id").alias("base"), F.least("size", F.lit(HEAD)).alias("head_size"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    rest = (
        turns.withColumn("h", _head("conv_id")).filter("pos >= h")
        .select("*", base, (F.col("pos") % SALTS).cast("int").alias("salt"))
        .join(known, ["base", "salt"], "left")
    )
    place = F.col("pos") - F.col("h") + F.least("h", F.coalesce("head_size", F.lit(0)))
    return first.unionByName(rest.select("conv_id", place.cast("long").alias("pos"), "turn_key", "chars")), sizes


def _head(conv_id: str) -> Column:
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEAD


def trie_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, k1, k2, p1, p2, conv_id, n_convs, chars, turn_key) with
    the key of their parent, and ends (depth, k1, k2, conv_id)."""
    marked = turns.select(
        "conv_id", "pos", "turn_key", "chars", F.xxhash64("turn_key", "pos").alias("h1"),
        F.xxhash64("pos", "turn_key", F.lit("second")).alias("h2"),
    )
    sums = ["h1", "h2"]
    paths = sorted_scan(marked, ["conv_id"], ["pos"], ["conv_id", "turn_key", "chars", *sums], sums)
    less = lambda c: F.expr(f"CAST(CAST(sum_{c} AS DECIMAL(20)) - h{c[-1]} AS DECIMAL(20))")
    rows = written(
        paths.select(
            "conv_id", "turn_key", "chars", (F.col("pos") + 1).alias("depth"), F.col("sum_h1").alias("k1"),
            F.col("sum_h2").alias("k2"), _wrapped(less("h1")).alias("p1"), _wrapped(less("h2")).alias("p2"),
            F.col("next_same").alias("goes_on"),
        ),
        "paths",
    )
    key = ["depth", "k1", "k2"]
    inner = rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("turn_key").alias("turn_key"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        *(zero.alias(c) for c in key), "conv_id", "n_convs", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"),
        F.lit(None).cast("binary").alias("turn_key"),
    )
    last = rows.filter("NOT goes_on").select(*key, "conv_id")
    turnless = convs.join(last, "conv_id", "left_anti").select(*(zero.alias(c) for c in key), "conv_id")
    return written(inner.unionByName(root), "nodes"), written(last.unionByName(turnless), "ends")


def _wrapped(x: Column) -> Column:
    """A difference of two longs, back in 64 bits."""
    two = F.lit("18446744073709551616").cast("decimal(20)")
    half = F.lit("9223372036854775808").cast("decimal(20)")
    return F.when(x >= half, x - two).when(x < -half, x + two).otherwise(x).cast("long")


def tour(nodes: DataFrame) -> DataFrame:
    """Families of the trie: one row per node as a parent (``kind`` 0) and
    one as a child (1), siblings in order of their smallest member."""
    own = nodes.select(
        F.col("depth").alias("d"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.lit(0).alias("kind"), "conv_id"
    )
    child = nodes.filter("depth > 0").select(
        (F.col("depth") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2"), F.lit(1).alias("kind"), "conv_id"
    )
    return written(
        sorted_scan(own.unionByName(child), ["d", "f1", "f2"], ["kind", "conv_id"], ["d", "kind", "conv_id"],
                    firsts=["conv_id"], nexts=["conv_id"]),
        "families",
    )


def arc(conv_id: str | Column, depth: str | Column, side: int) -> Column:
    c, d = (F.col(x) if isinstance(x, str) else x for x in (conv_id, depth))
    return F.struct(c.alias("c"), d.cast("long").alias("d"), F.lit(side).alias("s"))


def tour_links(families: DataFrame) -> DataFrame:
    """(a, n, w): every arc of the Euler tour and the arc that follows it."""
    d = F.col("d")
    enter = families.filter("kind = 0").select(
        arc("conv_id", d, 0).alias("a"),
        F.when(F.col("next_same"), arc("next_conv_id", d + 1, 0)).otherwise(arc("conv_id", d, 1)).alias("n"),
    )
    leave = families.filter("kind = 1").select(
        arc("conv_id", d + 1, 1).alias("a"),
        F.when(F.col("next_same"), arc("next_conv_id", d + 1, 0)).otherwise(arc("first_conv_id", d, 1)).alias("n"),
    )
    end = families.filter("kind = 0 AND d = 0").select(arc("conv_id", d, 1).alias("a"), F.lit(None).cast(enter.schema["n"].dataType).alias("n"))
    return enter.unionByName(leave).unionByName(end).withColumn("w", F.lit(1).cast("long"))


def subtree_sums(nodes: DataFrame, families: DataFrame, base: int = BASE) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) from prefix sums over the
    ranked tour."""
    ranks = list_ranks(tour_links(families), base)
    leaf = families.filter("kind = 0").select(
        "conv_id", F.col("d").alias("depth"), (~F.col("next_same")).cast("long").alias("leaf")
    )
    worth = leaf.join(
        nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), ["conv_id", "depth"]
    )
    arcs = ranks.select(F.col("a.c").alias("conv_id"), F.col("a.d").alias("depth"), F.col("a.s").alias("side"), "rank")
    weighted = arcs.join(worth, ["conv_id", "depth"]).select(
        "conv_id", "depth", (-F.col("rank")).alias("at"), F.lit(0).cast("long").alias("tour"),
        *(F.when(F.col("side") == 0, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")),
    )
    summed = sorted_scan(weighted, ["tour"], ["at"], ["conv_id", "depth", "leaf", "saved"], ["leaf", "saved"])
    inside = lambda c: F.max("sum_" + c) - F.min("sum_" + c) + F.sum(c)
    return summed.groupBy("conv_id", "depth").agg(inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens"))


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) rows as chunks of comma-joined ids."""
    names = ["depth", "k1", "k2", "first", "ids"]
    out, key, ids, size, first = [], None, [], 0, None

    def table():
        columns = list(zip(*out, strict=True))
        types = [pa.int64()] * 4 + [pa.binary()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        out.clear()
        return made

    load = 0
    for batch in batches:
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != key or size > CHUNK:
                if ids:
                    out.append((*key, first, ",".join(ids).encode()))
                    load += size + 64
                key, ids, size, first = node, [], 0, conv
                if load > 16 * CHUNK:
                    yield table()
                    load = 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        out.append((*key, first, ",".join(ids).encode()))
    if out:
        yield table()


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, in order."""
    names = ["depth", "k1", "k2", "ends_sha256"]
    key, digest = None, None

    def table(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        rows = []
        for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != key:
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
        yield table(rows)
    if key is not None:
        yield table([(*key, digest.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the ids of conversations that end at a
    node, ascending and comma-joined."""
    key = ["depth", "k1", "k2"]
    chunks = (
        ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
        .mapInArrow(_id_chunks, "depth long, k1 long, k2 long, first long, ids binary")
    )
    dealt = chunks.repartition(*key).sortWithinPartitions(*key, "first")
    return dealt.mapInArrow(_hash_chunks, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, base: int = BASE) -> DataFrame:
    """The trie of ``turns`` (conv_id, pos, turn_key, chars) of the
    conversations ``convs`` (conv_id): one row per node with conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    and turn_key (of its last turn)."""
    ship_package(turns.sparkSession)
    nodes, ends = trie_nodes(turns, convs)
    families = tour(nodes)
    parents = families.filter("kind = 1").select(
        "conv_id", (F.col("d") + 1).alias("depth"), F.col("first_conv_id").alias("parent_conv_id")
    )
    children = families.filter("kind = 1 AND NOT next_same").select(
        F.col("first_conv_id").alias("conv_id"), F.col("d").alias("depth"), F.col("pos").alias("n_children")
    )
    name = ["conv_id", "depth"]
    return (
        nodes.join(ends_digests(ends), ["depth", "k1", "k2"], "left")
        .join(parents, name, "left").join(children, name, "left")
        .join(subtree_sums(nodes, families, base), name)
        .select(
            *name, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
            "turn_key",
        )
    )


def with_turns(trie: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie with role and text of each node's last turn (null: the root)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(turn_key(role, text).alias("turn_key"), role.alias("role"), text.alias("text"))
    return trie.join(turns.dropDuplicates(["turn_key"]), "turn_key", "left")


def trie_digest(conversations: DataFrame, base: int = BASE) -> DataFrame:
    """The contract's table: the trie of the rebuilt conversations."""
    turns, sizes = rebuilt(turn_rows(conversations))
    return prefix_trie(turns, sizes.select("conv_id"), base).drop("turn_key")
