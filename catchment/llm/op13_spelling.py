"""Spelling variant grouping by a frequency-vector trie.

Method.  A word is the vector of its counts in ``GROUPS`` letter groups, and
the words are a trie whose level ``i`` branches on the count of group ``i``.
One inserted, deleted or replaced letter changes that vector by at most one
surplus and one deficit, so a depth-first search with a budget of one each
reaches every near word.  It walks the trie once for all searching words
together: at a node, each of them goes on to the child of its own count, to
the next count (spending the surplus) or to the one before (spending the
deficit).  A pair is searched from one side only: the first level that
differs must be a surplus.  Leaf words are verified letter by letter.

Scale.  The top levels of the trie deal its subtrees to tasks.  A subtree of
more than ``limit`` words is opened one level further, and only the searching
words whose budget allows it follow, so tasks stay bounded however the words
fall; words that share their whole vector are cut into parts that every
searching word visits.  Inside a task a subtree is held in memory and the
searching words stream past it.  Occurrences are summed per task before the
shuffle, so a word that a third of all texts repeat costs one row a task.
Near words are counted and the largest chosen by partial aggregation; roots
follow forms by pointer doubling (each step has at least ten times the
occurrences, so there are few).

Defined results: words are maximal runs of ASCII letters and U+00C0 to U+00FF,
A-Z lower-cased, one letter deleted where the hash of document and run says so
(a null id hashes as an empty one); null and empty texts have none.  Texts may
be of any length: runs are read from pieces of bounded size.  Repeated rows
count again; words of any length are compared whole.  Extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import ship_package, written

MIN_LENGTH, MIN_COUNT, DELETE_EVERY, FORM_RATIO = 7, 2, 31, 10

# Letters of each level of the trie, the commonest first; all
# others (ASCII, then accented) share the last two levels.
LEVELS = ["e", "t", "a", "n", "i", "o", "r", "s", "h", "l", "d", "u", "c", "m", "bfgjkpqvwxyz"]
GROUPS = len(LEVELS) + 1

#: Levels by which subtrees are first dealt, and words of a subtree in a task.
TOP, LIMIT = 3, 16_384
#: Words below a node that are compared at once instead of walking on.
LEAF = 64
#: Code points of a text handled at once, and distinct words a task holds
#: before it passes its counts on.
PIECE, HELD = 1 << 20, 400_000
#: Letters compared in fixed-width arrays; longer words are compared one by one.
WIDTH = 32
#: First or last letters that leaf words share: one letter changes one end
#: only, as words have ``MIN_LENGTH`` > 2 x ENDS letters.
ENDS = 3

_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_LENGTH)
_OUTSIDE = re.compile(rb"[^a-z\xc0-\xff]")


def _group_of() -> np.ndarray:
    table = np.full(256, GROUPS - 1, np.uint8)
    for level, letters in enumerate(LEVELS):
        table[np.frombuffer(letters.encode(), np.uint8)] = level
    return table


_GROUP = _group_of()


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_of(start: np.ndarray, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of the words ``data[at : at + size]``, each continued from the
    checksum ``start`` of what stands before it."""
    order = np.argsort(-sizes, kind="stable")
    state, at, sizes = ~start[order], at[order], sizes[order]
    live = np.searchsorted(-sizes, -np.arange(min(int(sizes.max(initial=0)), WIDTH)), "left")
    for k, n in enumerate(live.tolist()):
        head = state[:n]
        state[:n] = _CRC[(head ^ data[at[:n] + k]) & 0xFF] ^ (head >> 8)
    state = ~state
    for i in range(int(np.searchsorted(-sizes, -WIDTH, "left"))):  # the rest of longer words
        state[i] = zlib.crc32(data[at[i] + WIDTH : at[i] + sizes[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end outside a run."""
    at = 0
    while len(text) - at > PIECE:
        cut = _OUTSIDE.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class WordCounter:
    """Occurrences of the words of texts.  Words are Latin-1 bytes, one a code
    point: every letter of a run has one, all else becomes a separator."""

    def __init__(self) -> None:
        self.counts: Counter[bytes] = Counter()
        self._runs, self._starts, self._load = [], [], 0

    def add(self, doc_id: str, text: str) -> None:
        start = zlib.crc32(f"{doc_id}:".encode())
        for piece in _pieces(text.encode("latin-1", "replace").lower()):  # bytes: only A-Z change
            runs = _RUN.findall(piece)
            self._runs += runs
            self._starts.append((start, len(runs)))
            self._load += len(piece)
            if self._load > PIECE:
                self.settle()

    def settle(self) -> None:
        """Count the runs held, with the hashed deletions."""
        runs, self._runs, self._load = self._runs, [], 0
        starts, self._starts = self._starts, []
        if not runs:
            return
        joined = b"".join(runs)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        wide = np.add.reduceat(np.frombuffer(joined, np.uint8) >= 0x80, np.cumsum(sizes) - sizes, dtype=np.int64)
        data = np.frombuffer(joined.decode("latin-1").encode(), np.uint8)
        octets = sizes + wide
        first = np.repeat(*np.array(starts, np.int64).T).astype(np.uint32)
        hashes = crc32_of(first, data, np.cumsum(octets) - octets, octets)
        self.counts.update(runs)
        for i in np.flatnonzero(hashes % DELETE_EVERY == 0).tolist():
            run, at = runs[i], int(hashes[i]) % len(runs[i])
            self.counts[run] -= 1
            if len(run) > MIN_LENGTH:
                self.counts[run[:at] + run[at + 1 :]] += 1

    def taken(self) -> dict[bytes, int]:
        self.settle()
        counts, self.counts = self.counts, Counter()
        return {word: n for word, n in counts.items() if n}


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = WordCounter()

    def flush() -> pa.RecordBatch:
        counts = counter.taken()
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            if text.is_valid:
                counter.add(doc_id.as_py() or "", text.as_py())
            if len(counter.counts) > HELD:
                yield flush()
    yield flush()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with at least ``MIN_COUNT`` occurrences."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    parts = texts.mapInArrow(_count_texts, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _level_count(level: int) -> Column:
    """How many letters of a level's group ``word`` has."""
    if level < len(LEVELS):
        return F.length("word") - F.length(F.translate("word", LEVELS[level], ""))
    return F.length(F.translate("word", "".join(LEVELS), ""))


def _step(rows: DataFrame, level: int) -> DataFrame:
    """One level down: stored words follow their own count, searching words
    also the counts that their budget allows."""
    count, search = F.col("__count"), F.col("search")
    ways = F.array(
        F.struct(count.alias("c"), F.col("state").alias("s")),
        F.when(search & (F.col("state") == 0), F.struct((count + 1).alias("c"), F.lit(1).alias("s"))),
        F.when(search & (F.col("state") == 1) & (count > 0), F.struct((count - 1).alias("c"), F.lit(2).alias("s"))),
    )
    ways = F.filter(ways, lambda way: way.isNotNull())
    return (
        rows.withColumn("__count", _level_count(level))
        .withColumn("__way", F.explode(ways))
        .select("word", "n", "search", F.concat_ws(".", "path", F.col("__way.c").cast("string")).alias("path"),
                F.col("__way.s").alias("state"))
    )


def deal_subtrees(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(path, search, state, word, n): every stored word in the subtree
    ``path`` and every searching word in each subtree its budget reaches.
    A subtree has at most about ``limit`` stored words."""
    both = words.withColumn("search", F.explode(F.array(F.lit(False), F.lit(True))))
    rows = both.select("word", "n", "search", F.lit("").alias("path"), F.lit(0).alias("state"))
    for level in range(TOP):
        rows = _step(rows, level)
    dealt, level = [], TOP
    while True:
        sizes = written(rows.filter("NOT search").groupBy("path").agg(F.count(F.lit(1)).alias("size")), "subtree-sizes")
        marked = rows.join(sizes, "path").withColumn("opened", F.col("size") > limit)
        stage = written(marked, "subtrees", ["opened"])
        dealt.append(stage.filter("NOT opened").select("path", "search", "state", "word", "n"))
        rest = stage.filter("opened")
        if rest.isEmpty():
            break
        if level == GROUPS:  # one vector: parts of it, each visited by all that search it
            parts = F.ceil(F.col("size") / limit).cast("int")
            own = F.array(F.pmod(F.xxhash64("word"), parts).cast("int"))
            part = F.explode(F.when(F.col("search"), F.sequence(F.lit(0), parts - 1)).otherwise(own))
            cut = rest.withColumn("part", part).withColumn("path", F.concat_ws("#", "path", "part"))
            dealt.append(cut.select("path", "search", "state", "word", "n"))
            break
        rows, level = _step(rest.drop("size", "opened"), level), level + 1
    out = dealt[0]
    for more in dealt[1:]:
        out = out.unionByName(more)
    return out


def _search_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (path, search): hold a subtree's stored words, stream
    the searching words past them."""
    path, stored, counts, tree = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, search = batch.column(0), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        states, totals = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        words = [w.encode("latin-1") for w in batch.column(3).to_pylist()]
        ids = paths.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(search) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            here = paths[a].as_py()
            if here != path:
                path, stored, counts, tree = here, [], [], None
            if not search[a]:
                stored += words[a:b]
                counts.append(totals[a:b])
                continue
            if not stored:  # a part of a cut class that got no word
                continue
            if tree is None:
                tree = Subtree(stored, _depth(path))
                n = np.concatenate(counts)[tree.order]
            left, right = tree.search(words[a:b], states[a:b].astype(np.int8))
            if len(left):
                mine = [words[a + i].decode("latin-1") for i in left]
                theirs = [tree.words[i].decode("latin-1") for i in right]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine + theirs, pa.string()), pa.array(theirs + mine, pa.string()),
                     pa.array(np.concatenate([n[right], totals[a:b][left]]), pa.int64())],
                    ["word", "near", "near_n"],
                )


def _depth(path: str) -> int:
    return len(path.split("#")[0].split(".")) - 1


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, near, near_n): both directions of every near pair of ``words``
    (distinct, with their occurrences ``n``)."""
    ship_package(words.sparkSession)
    rows = deal_subtrees(words, limit).repartition("path").sortWithinPartitions("path", "search")
    return rows.mapInArrow(_search_partition, "word string, near string, near_n long")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: the last form of each chain."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(ahead, "root", "left")
        step = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                       "roots")
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their
    occurrences: the near word with the most occurrences, if it has at least
    ``FORM_RATIO`` times the word's, and where the chain of forms ends."""
    words = written(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form")))
    near = near_words(words, limit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    form_n = -F.col("best.order")
    takes = form_n >= FORM_RATIO * F.col("n")
    found = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(takes, F.col("best.form")).alias("form"), F.when(takes, form_n).alias("form_n"),
        ),
        "forms",
    )
    roots = follow_forms(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_digest(docs: DataFrame) -> DataFrame:
    return spelling_variants(count_words(docs))


# --- search of one subtree -------------------------------------------------


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(letters padded to WIDTH, lengths) of words; longer ones are cut."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.array(words, f"S{WIDTH}").view(np.uint8).reshape(len(words), WIDTH), sizes


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter-group counts of words, one row each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    groups = _GROUP[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    cell = np.repeat(np.arange(len(words)), sizes) * GROUPS + groups
    return np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # longest common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


class Words:
    """Words with their letters, sizes, vectors, first and last letters."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, self.vecs = words, vectors(words)
        self.letters, self.sizes = _letters(words)
        self.heads = np.array([int.from_bytes(w[:ENDS]) for w in words], np.int32)
        self.tails = np.array([int.from_bytes(w[-ENDS:]) for w in words], np.int32)


class Subtree(Words):
    """The words of one subtree, sorted by their vectors: a node of the trie
    is a range of them."""

    def __init__(self, words: list[bytes], level: int) -> None:
        self.order, self.level = np.lexsort(vectors(words).T[::-1]), level
        super().__init__([words[i] for i in self.order])

    def search(self, words: list[bytes], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (searching word, word of the subtree) that are near.  The
        state of a searching word says what its way to this subtree spent:
        0 nothing, 1 the surplus, 2 surplus and deficit."""
        searching = Words(words)
        found, waiting, load = [], [], 0
        stack = [(0, len(self.words), self.level, np.arange(len(words)), state)]
        while stack:
            lo, hi, level, at, st = stack.pop()
            if hi - lo > LEAF and level < GROUPS:
                column = self.vecs[lo:hi, level]
                ends = np.flatnonzero(np.diff(column)) + 1
                own = searching.vecs[at, level]
                for a, b in zip([0, *ends.tolist()], [*ends.tolist(), hi - lo], strict=True):
                    gap = column[a] - own
                    go = np.flatnonzero((gap == 0) | ((gap == 1) & (st == 0)) | ((gap == -1) & (st == 1)))
                    if len(go):
                        stack.append((lo + a, lo + b, level + 1, at[go], st[go] + (gap[go] != 0)))
                continue
            step = max(1, (1 << 18) // (hi - lo))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                q, w = self._alike(searching, part, lo, hi)
                waiting.append((part[q], w))
                load += len(q)
                if load > 1 << 16:
                    found.append(self._verify(searching, waiting))
                    waiting, load = [], 0
        found.append(self._verify(searching, waiting))
        left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        return left, right

    def _alike(self, searching: Words, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words ``at`` and leaf words with the same first or last
        letters: near words have one of both, as they are long enough."""
        same = searching.heads[at, None] == self.heads[None, lo:hi]
        same |= searching.tails[at, None] == self.tails[None, lo:hi]
        q, w = np.nonzero(same)
        return q, w + lo

    def _verify(self, searching: Words, pairs) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that differ by exactly one letter and that this side
        reports: the word that lacks the first surplus, or the smaller one of
        two with the same vector.  (A word one letter longer never reports.)"""
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
        grown = self.sizes[right] - searching.sizes[left]
        keep = np.flatnonzero((grown == 0) | (grown == 1))
        if not len(keep):
            return keep, keep
        left, right, grown = left[keep], right[keep], grown[keep]
        longest = self.sizes[right]
        width = min(WIDTH, int(longest.max(initial=0)) + 1)
        a, b = searching.letters[left, :width], self.letters[right, :width]
        differ = a != b
        first = differ.argmax(1)
        moved = a[:, :-1] != b[:, 1:]
        last = width - 2 - moved[:, ::-1].argmax(1)
        near = np.where(grown == 0, differ.sum(1) == 1, ~moved.any(1) | (last < first))
        at = np.arange(len(left))
        smaller = a[at, first] < b[at, first]
        for i in np.flatnonzero(longest >= WIDTH).tolist():
            x, y = searching.words[left[i]], self.words[right[i]]
            near[i], smaller[i] = one_edit(x, y), x < y
        left, right, smaller = left[near], right[near], smaller[near]
        gap = self.vecs[right] - searching.vecs[left]
        lead = gap[np.arange(len(gap)), (gap != 0).argmax(1)]
        reports = (lead > 0) | ((lead == 0) & smaller)
        return left[reports], right[reports]
