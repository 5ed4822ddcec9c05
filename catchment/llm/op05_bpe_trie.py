"""BPE encoding and decoding by a prefix-sharing trie traversal.

Method.  The distinct new words of a slice of texts are the paths of a trie.
BPE has the property that the last token of a prefix's encoding, together
with the last tokens of shorter prefixes, gives that whole encoding; so the
traversal keeps one last token for each depth.  At a node it tries the
vocabulary's tokens that end there, longest first, and takes the one that may
follow the last token of the node where it begins: no merge across their
border comes earlier than the merges that bind the border's symbols inside
the tokens.  The traversal is depth-first (words in sorted order), so the
states of a shared prefix are computed once and the memory is one path.  The
last symbol of a word carries the word-end mark and is an edge of its own.

Encodings of words are kept per Python worker, up to ``MAX_BYTES``; the
work is a map over Arrow batches without a shuffle, in slices of about a
megabyte of text.

Defined results: null and empty texts have no tokens and decode to an empty
text; strings of special tokens inside texts become those tokens; a word of
any length is one path; repeated rows each get their row; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import tokens as T
from .buffers import slices, text_buffer
from .stage import ship_package

#: Bytes of chunks (about; ENTRY for the objects of one) and number of token
#: pairs that a worker remembers before it starts anew.
MAX_BYTES, ENTRY, MAX_PAIRS = 288 << 20, 360, 1_000_000


class TrieEncoder:
    def __init__(self, vocab: T.Vocabulary) -> None:
        self.v = vocab
        # Tokens by their symbols; the word end is one more symbol after the last byte's letter.
        self.inner = {t: i for t, i in vocab.ids.items() if not t.endswith(T.WORD_END)}
        self.final = {t[: -len(T.WORD_END)]: i for t, i in vocab.ids.items() if t.endswith(T.WORD_END)}
        self.size = {i: len(t) for t, i in self.inner.items()} | {i: len(t) for t, i in self.final.items()}
        # Longest token that ends in the given two letters.
        self.reach_inner, self.reach_final = self._reach(self.inner), self._reach(self.final)
        self.follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._right, self._left = functools.lru_cache(None)(self._right), functools.lru_cache(None)(self._left)

    @staticmethod
    def _reach(table: dict[str, int]) -> dict[str, int]:
        reach: dict[str, int] = {}
        for t in table:
            reach[t[-2:]] = max(len(t), reach.get(t[-2:], 1))
        return reach

    def _right(self, t: int) -> list[tuple[int, float]]:
        """Tokens that stand at the right border of ``t`` while it is built,
        each with the rank of the merge that ends it."""
        out, ends = [(t, float("inf"))], t
        while ends in self.v.parts:
            out.append((self.v.parts[ends][1], self.v.born[ends]))
            ends = self.v.parts[ends][1]
        return out

    def _left(self, t: int) -> list[tuple[int, float]]:
        out, ends = [(t, float("inf"))], t
        while ends in self.v.parts:
            out.append((self.v.parts[ends][0], self.v.born[ends]))
            ends = self.v.parts[ends][0]
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' symbols is just ``a, b``."""
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > MAX_PAIRS:
                self.follows.clear()
            known = self.follows[a, b] = self.whole(b) and self._bound(a, b, None)
        return known

    def _bound(self, a: int, b: int, within: int | None) -> bool:
        """No merge over the border of ``a`` and ``b`` comes before both
        border tokens are bound elsewhere; of equal merges the left one goes
        first.  ``within``: the rank at which the two are merged themselves."""
        rank, last = self.v.rank, float("inf") if within is None else within
        lefts = self._left(b)
        for x, x_end in self._right(a):
            for y, y_end in lefts:
                r = rank.get((x, y))
                if r is not None and r < min(x_end, last) and r <= min(y_end, last):
                    return False
        return True

    def whole(self, t: int) -> bool:
        """Whether the token's own symbols encode to it."""
        known = self._whole.get(t)
        if known is None:
            parts = self.v.parts.get(t)
            known = parts is None or (
                self._bound(*parts, self.v.born[t]) and self.whole(parts[0]) and self.whole(parts[1])
            )
            self._whole[t] = known
        return known

    def _last(self, word: str, end: int, last: list[int], table: dict[str, int], reach: dict[str, int]) -> int:
        follows = self.follows
        for start in range(max(0, end - reach.get(word[max(0, end - 2) : end], 1)), end):
            t = table.get(word[start:end])
            if t is None:
                continue
            if start:
                fits = follows.get((last[start], t))
                if fits is None:
                    fits = self.may_follow(last[start], t)
            else:
                fits = self.whole(t)
            if fits:
                return t
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of each of the words, written in byte letters."""
        out: dict[str, list[int]] = {}
        last, path = [-1], ""  # last[d]: last token of the first d symbols, without a word end
        for word in sorted(words):
            shared, most = 0, min(len(last) - 1, len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word)):
                last.append(self._last(word, end, last, self.inner, self.reach_inner))
            t = self._last(word, len(word), last, self.final, self.reach_final)
            ids, at = [t], len(word) - self.size[t]
            while at:
                t = last[at]
                ids.append(t)
                at -= self.size[t]
            ids.reverse()
            out[word] = ids
            path = word
        return out


class Codec:
    """Words, and chunks of words between white space, to packed ids and to
    decoded text, remembered per worker."""

    def __init__(self, path: str, max_bytes: int = MAX_BYTES) -> None:
        self.vocab, self.max_bytes = T.vocabulary(path), max_bytes
        self.trie = TrieEncoder(self.vocab)
        self._reset()

    def _reset(self) -> None:
        self.load = 0
        self.words: dict[str, tuple[bytes, str]] = {}
        self.packed = {"\n" + t: np.array([i], "<u4").tobytes() for t, i in self.vocab.special.items()}
        # The file names no decoder: tokens are joined by spaces.
        self.spoken = {"\n" + t: t for t in self.vocab.special}

    def learn(self, chunks: set[str]) -> None:
        """Encode what is new.  Millions of strings are made and none are
        cyclic, so the cycle collector would only scan them again and again."""
        gc.disable()
        try:
            self._learn(chunks)
        finally:
            gc.enable()

    def _learn(self, chunks: set[str]) -> None:
        if self.load > self.max_bytes:
            self._reset()
        packed, spoken, words = self.packed, self.spoken, self.words
        split = {c: self.vocab.pieces(c) for c in chunks if c not in packed}
        new = {w for pieces in split.values() for w in pieces if w not in words}
        letters, text = self.vocab.letters, self.vocab.text
        spelled = {"".join([letters[b] for b in w.encode("utf-8", "surrogatepass")]): w for w in new}
        for s, ids in self.trie.encode(list(spelled)).items():
            words[spelled[s]] = array("I", ids).tobytes(), " ".join([text[i] for i in ids])
        for c, pieces in split.items():
            if len(pieces) == 1:
                packed[c], spoken[c] = words[pieces[0]]
            else:
                packed[c] = b"".join([words[w][0] for w in pieces])
                spoken[c] = " ".join([words[w][1] for w in pieces])
            self.load += ENTRY + 2 * len(c) + len(packed[c]) + len(spoken[c])


@functools.lru_cache(2)
def codec(path: str, max_bytes: int = MAX_BYTES) -> Codec:
    return Codec(path, max_bytes)


def encoded_slices(texts: list[str], path: str, max_bytes: int = MAX_BYTES) -> Iterator[tuple[bytes, str]]:
    """Packed ids and decoded text of each text."""
    c = codec(path, max_bytes)
    split = [c.vocab.chunks(t) for t in texts]
    c.learn(set().union(*split))
    for chunks in split:
        yield b"".join([c.packed[x] for x in chunks]), " ".join([c.spoken[x] for x in chunks])


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about a megabyte with their texts (null: empty)."""
    col = batch.column(batch.schema.get_field_index(column))
    _, offsets = text_buffer(col)
    for a, b in slices(offsets):
        yield a, b, [t or "" for t in col.slice(a, b - a).to_pylist()]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_texts(
    df: DataFrame, text_col: str = "text", vocab_path: str | None = None, hashed: bool = False, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """The columns of ``df`` and ``token_ids`` (array<int>), ``decoded_text``;
    with ``hashed`` the texts are left out, and ``decoded_sha256`` stands for
    the decoded one, hashed where it is made.  A worker remembers chunks up to
    about ``max_bytes``."""
    ship_package(df.sparkSession)
    path = vocab_path or T.default_path()
    last = "decoded_sha256" if hashed else "decoded_text"
    kept = [f for f in df.schema.fields if not (hashed and f.name == text_col)]
    out_schema = StructType([*kept, StructField("token_ids", ArrayType(IntegerType())), StructField(last, StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                packed, decoded = [], []
                for ids, spoken in encoded_slices(texts, path, max_bytes):
                    packed.append(ids)
                    decoded.append(_sha256(spoken) if hashed else spoken)
                sizes = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
                columns = [batch.column(f.name).slice(a, b - a) for f in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.ListArray.from_arrays(pa.array(sizes), ids), pa.array(decoded, pa.string())],
                    names=out_schema.names,
                )

    return df.mapInArrow(work, out_schema)


def bpe_digest(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    ship_package(docs.sparkSession)
    path = vocab_path or T.default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch, "text"):
                counts, ids, decoded = [], [], []
                for packed, spoken in encoded_slices(texts, path):
                    counts.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(_sha256(spoken))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                     pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
