"""Approximate nearest neighbours by a forest of random-projection trees.

Method.  Every tree halves space again and again by random directions, each
at the median of a bounded sample (``FIT_ROWS`` rows with the smallest id
hashes; the forest is a few megabytes).  Every vector is routed down all
trees and indexed by its leaves.  A query searches all trees through one
shared priority queue, nearest split planes first, until the leaves it took
hold ``search_rows`` rows.  Per leaf, the queries that took it are compared
exactly with its vectors, in double precision, and the best of all leaves
are merged per query.  A leaf only reports rows within the distance of the
query's k-th nearest among the sampled rows that its own leaves hold: the k
nearest found are no farther, so nothing is lost and little is merged.  A query stops after ``SEARCH_SHARE`` times all rows,
counted per tree (about half of the distinct rows): the given vectors have
little structure, and recall over 0.9 against brute force needs that much.
Clustered vectors need far less; both figures are parameters.

Scale.  The index is one row per vector; a leaf's rows meet in groups of at
most ``GROUP_ROWS``, larger leaves (many near-equal vectors) being split by
id hash with their queries sent to each part.  Queries are searched in tasks;
the per-leaf top k bounds what is merged.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows with a null id, take no part; so do vectors whose length
isn't the most frequent one (the smaller of equally frequent); rows with the
same id are one row (the smallest vector); equal scores are ranked by id; with
fewer candidates all are returned; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import ship_package, written

TREES, LEAF_ROWS, SEED = 8, 256, 11
#: Bound of the sample that the split planes are fitted on.
FIT_ROWS = 32_768
#: Rows a query looks at, those met in several trees counted each time: a
#: share of all rows, and at least so many.
SEARCH_SHARE, SEARCH_LEAST = 0.8, 4_000
GROUP_ROWS = 4_096
TOP = 10


class Forest:
    """Balanced trees in heap layout: node ``n`` has children ``2n + 1``, ``2n + 2``."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        rng = np.random.default_rng(SEED)
        self.depth, d = depth, sample.shape[1]
        inner = (1 << depth) - 1
        self.normals = rng.normal(size=(TREES, inner, d))
        self.cuts = np.zeros((TREES, inner))
        for t in range(TREES):
            members = {0: np.arange(len(sample))}
            for n in range(inner):
                rows = members.pop(n, np.empty(0, int))
                if len(rows):
                    # A random direction of the node's own points: towards one from another.
                    way = np.subtract(*sample[rng.choice(rows, 2)])
                    if way.any():
                        self.normals[t, n] = way
                    self.normals[t, n] /= np.linalg.norm(self.normals[t, n])
                    side = sample[rows] @ self.normals[t, n]
                    self.cuts[t, n] = np.median(side)
                    right = side >= self.cuts[t, n]
                    members[2 * n + 1], members[2 * n + 2] = rows[~right], rows[right]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector in each tree."""
        out = np.zeros((len(x), TREES), np.int32)
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("nd,nd->n", x, self.normals[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, rows: int) -> list[tuple[int, int]]:
        """(tree, leaf) pairs, by one queue over all trees, until they hold ``rows`` rows."""
        margins = self.normals @ q - self.cuts
        queue = [(-np.inf, t, 0) for t in range(TREES)]
        heapq.heapify(queue)
        inner, taken, out = (1 << self.depth) - 1, 0, []
        while queue and taken < rows:
            far, t, n = heapq.heappop(queue)
            while n < inner:  # the near side goes on, the far side waits at its distance
                m = margins[t, n]
                near = 2 * n + 1 + (m >= 0)
                heapq.heappush(queue, (max(far, abs(m)), t, 4 * n + 3 - near))
                n = near
            if sizes[t, n - inner]:
                out.append((t, n - inner))
                taken += sizes[t, n - inner]
        return out


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, one per id; ``vec`` as doubles
    (exact for floats)."""
    v: Column = F.col(vec_col).cast("array<double>")
    good = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), v.alias("vec")
    ).filter(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    lengths = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return good
    return good.filter(F.size("vec") == lengths[0]["n"]).groupBy("id").agg(F.min("vec").alias("vec"))


def pack(vec: np.ndarray) -> bytes:
    return np.asarray(vec, "<f8").tobytes()


def unpack(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<f8").reshape(len(col), -1)


def nearest(
    df: DataFrame, is_query: Column, id_col: str, vec_col: str, k: int = TOP,
    share: float = SEARCH_SHARE, least: int = SEARCH_LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of the rows
    with ``is_query``, by Euclidean distance."""
    spark = df.sparkSession
    ship_package(spark)
    out = "query_id long, vec_id long, score double"
    rows = written(
        usable_vectors(df, id_col, vec_col).mapInPandas(
            lambda frames: (pd.DataFrame({"id": f["id"], "vec": [pack(v) for v in f["vec"]]}) for f in frames),
            "id long, vec binary",
        ),
        "vectors",
    )
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The sample: the smallest id hashes below a cut that leaves about FIT_ROWS of them.
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    cut = (1 << 20) if n <= FIT_ROWS else int((1 << 20) * FIT_ROWS / n) + 1
    sample = rows.filter(mark < cut).select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas()
    depth = max(0, int(np.ceil(np.log2(max(1, min(n, FIT_ROWS * 8) / LEAF_ROWS)))))
    known = unpack(sample["vec"])
    forest = spark.sparkContext.broadcast(Forest(known, depth))
    sampled = spark.sparkContext.broadcast(
        (sample["id"].to_numpy(), known, np.einsum("nd,nd->n", known, known), forest.value.leaves(known))
    )

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(leaves=list(forest.value.leaves(unpack(f["vec"]))))

    indexed = written(rows.mapInPandas(route, "id long, vec binary, leaves array<int>"), "forest-index")
    counts = indexed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()
    sizes = np.zeros((TREES, 1 << depth), np.int64)
    for r in counts:
        sizes[r["tree"], r["leaf"]] = r["count"]
    shared = spark.sparkContext.broadcast(sizes)
    budget = max(least, int(share * n))

    def bound(qid: int, squares: np.ndarray, taken: list[tuple[int, int]]) -> float:
        """Distance, rounded up, of the query's k-th nearest sampled row in its leaves."""
        own, _, norms, leaves = sampled.value
        open_leaf = np.zeros(shared.value.shape, bool)
        open_leaf[tuple(np.array(taken).T)] = True
        found = squares[open_leaf[np.arange(TREES), leaves].any(1) & (own != qid)]
        if len(found) < k:
            return np.inf
        return float(np.sqrt(max(np.partition(found, k - 1)[k - 1], 0) + 1e-9 * (1 + norms.max())))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 64):
                part = f.iloc[at : at + 64]
                x = unpack(part["vec"])
                _, y, norms, _ = sampled.value
                squares = np.einsum("nd,nd->n", x, x)[:, None] + norms[None] - 2 * (x @ y.T)
                hits = []
                for i, v, q, near in zip(part["id"], part["vec"], x, squares, strict=True):
                    taken = forest.value.search(q, shared.value, budget)
                    most = bound(i, near, taken)
                    for t, leaf in taken:
                        parts_of = -(-int(shared.value[t, leaf]) // GROUP_ROWS)
                        hits += [(i, v, most, t, leaf, salt) for salt in range(parts_of)]
                yield pd.DataFrame(hits, columns=["query_id", "query", "most", "tree", "leaf", "salt"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = indexed.filter(is_query).select("id", "vec").repartition(parts, F.xxhash64("id")).mapInPandas(
        search, "query_id long, query binary, most double, tree int, leaf int, salt int"
    )
    leaf_parts = spark.createDataFrame(
        [(r["tree"], r["leaf"], -(-r["count"] // GROUP_ROWS)) for r in counts], "tree int, leaf int, parts int"
    )
    placed = (
        indexed.select("id", "vec", F.posexplode("leaves").alias("tree", "leaf"))
        .join(F.broadcast(leaf_parts), ["tree", "leaf"])
        .select("tree", "leaf", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"), "id", "vec")
    )

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = unpack(c["vec"]), c["id"].to_numpy()
        norms = np.einsum("nd,nd->n", x, x)
        found = []
        for a in range(0, len(q), 256):
            block = q.iloc[a : a + 256]
            y = unpack(block["query"])
            near = norms[None] - 2 * (y @ x.T)
            for i, (qid, most) in enumerate(zip(block["query_id"], block["most"], strict=True)):
                near[i, ids == qid] = np.inf
                size = min(k, len(ids))
                worst = np.partition(near[i], size - 1)[size - 1]
                # Rounding of the fast form cannot hide a row: near ties stay in.
                at = np.flatnonzero((near[i] <= worst + 1e-9 * (1 + norms.max())) & (ids != qid))
                exact = np.sqrt(((x[at] - y[i]) ** 2).sum(1))
                best = np.lexsort((ids[at], exact))[:k]
                best = best[exact[best] <= most]
                found.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at][best], "score": exact[best]}))
        return pd.concat(found)

    keys = ["tree", "leaf", "salt"]
    best = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(compare, out)
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
