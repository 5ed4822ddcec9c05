"""Token counts by rank-synchronous merging of ragged arrays.

Method.  The distinct new words of a slice of texts lie in one flat numpy
array of symbols with the word of each.  In a step every word applies its
own lowest-ranked pair, at all its places at once (of overlapping places the
left one first), and the array is compacted; words without a pair left are
done and their surviving symbols counted.  Only pairs next to a merge are
looked up again.  A text's count is the sum over its words.

Counts of words are kept per Python worker, up to ``MAX_WORDS``; the work is
a map over Arrow batches without a shuffle, in slices of about a megabyte.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of
special tokens inside texts count one token each; a word of any length is one
ragged row; repeated rows each get their row; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as T
from .buffers import text_buffer
from .op05_bpe_trie import text_slices
from .stage import ship_package

#: A text with more tokens than this is over the limit.
TOKEN_LIMIT = 2048
#: Words a worker remembers before it starts anew, and symbols merged at once.
MAX_WORDS, MAX_SYMBOLS = 500_000, 1 << 20

NO_PAIR = np.int64(1 << 40)


class RaggedCounter:
    def __init__(self, vocab: T.Vocabulary) -> None:
        self.v = vocab
        keys = np.array([a << 20 | b for a, b in vocab.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(vocab.rank.values(), np.int64, len(keys))[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NO_PAIR)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (at least one byte long)."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        cuts = np.cumsum(sizes)
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(cuts, (cuts[a - 1] if a else 0) + MAX_SYMBOLS, "right")))
            out[a:b] = self._count(words[a:b], sizes[a:b])
            a = b
        return out

    def _count(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        sym = self.v.mid[raw]
        sym[ends] = self.v.end[raw[ends]]
        rank = np.full(len(sym), NO_PAIR)
        rank[:-1] = self.rank_of(sym[:-1], sym[1:])
        rank[ends] = NO_PAIR
        out = np.zeros(len(words), np.int64)
        while len(sym):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            done = lowest == NO_PAIR
            if done.any():
                out[row[first[done]]] = length[done]
                stay = np.repeat(~done, length)
                sym, row, rank = sym[stay], row[stay], rank[stay]
                lowest, length = lowest[~done], length[~done]
                if not len(sym):
                    break
            low = np.repeat(lowest, length)
            hit = np.flatnonzero(rank == low)
            # Places that overlap come in runs of neighbours: every second one of a run is merged.
            head = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])
            run = np.repeat(hit[head], np.diff(np.r_[head, len(hit)]))
            hit = hit[(hit - run) % 2 == 0]
            sym[hit] = self.v.merged[low[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, row, rank = sym[stay], row[stay], rank[stay]
            hit = place[hit]
            near = np.unique(np.r_[hit, hit[hit > 0] - 1])
            rank[near] = NO_PAIR
            near = near[near < len(sym) - 1]
            near = near[row[near] == row[near + 1]]
            rank[near] = self.rank_of(sym[near], sym[near + 1])
        return out


class Counter:
    """Tokens of words, and of chunks between white space, remembered per worker."""

    def __init__(self, path: str) -> None:
        self.vocab = T.vocabulary(path)
        self.ragged = RaggedCounter(self.vocab)
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.known = {"\n" + t: 1 for t in self.vocab.special}

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > MAX_WORDS:
            self._reset()
        known, words = self.known, self.words
        split = [self.vocab.chunks(t) for t in texts]
        fresh = {c: self.vocab.pieces(c) for c in set().union(*split) if c not in known}
        new = [w for w in {w for pieces in fresh.values() for w in pieces} if w not in words]
        if new:
            spelled = [w.encode("utf-8", "surrogatepass") for w in new]
            words.update(zip(new, self.ragged.count(spelled).tolist(), strict=True))
        for c, pieces in fresh.items():
            known[c] = sum([words[w] for w in pieces])
        return [sum(map(known.__getitem__, chunks)) for chunks in split]


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocab_path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    ship_package(docs.sparkSession)
    path = vocab_path or T.default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            sizes = np.diff(offsets)
            for a, b, texts in text_slices(batch, "text"):
                n = np.array(counter(path).counts(texts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes[a:b]), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
