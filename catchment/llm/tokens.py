"""The word-end BPE vocabulary file and its pre-tokenizer, shared by the
encoder (``op05_bpe_trie``) and the counter (``op07_token_counts``).

The file's normalizer (NFC, white space to a space, lower case) and splitter
act on the text between special tokens.  Texts without code points from
U+0300 on need no composition and lower-case alike everywhere, so plain Python
does for them; others go through the library's own normalizer and
splitter.  The merges themselves are applied by the operators.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

DEFAULT_VOCAB = "word_bpe_49k.json"
WORD_END = "</w>"

# The splitter's pattern, as the vocabulary file gives it.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
)
_ABOVE = re.compile("[\u0300-\U0010ffff]")
#: White space to Python's ``split`` but not to the splitter.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCAB)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tables of a vocabulary file.  A token is its id; ``parts[id]`` are the
    two tokens merged into it and ``rank[(a, b)]`` the order of that merge."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.text = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.letter_of = dict(enumerate(self.letters))
        self.mid = np.array([self.ids[c] for c in self.letters], np.int64)
        self.end = np.array([self.ids[c + WORD_END] for c in self.letters], np.int64)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, new = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[x, y] = r
            self.parts[new] = (x, y)
            self.born[new] = r
        self.merged = np.array([self.ids[a + b] for a, b in merges], np.int64)
        self._library = Tokenizer.from_file(path)
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space (which no pre-token holds), normalized;
        a special token is a chunk that starts with a line feed."""
        if self._special is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append("\n" + m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if (text.isascii() or not _ABOVE.search(text)) and not _SEPARATORS.search(text):
            return text.lower().split()
        lib = self._library
        split = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [self._bytes(w).decode("utf-8", "surrogatepass") for w, _ in split]

    @staticmethod
    def pieces(chunk: str) -> list[str]:
        """Pre-tokens of a chunk (of one that is a pre-token: itself)."""
        return PIECES.findall(chunk)

    @functools.cached_property
    def _byte_of(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(self.letters)}

    def _bytes(self, letters: str) -> bytes:
        return bytes(map(self._byte_of.__getitem__, letters))


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    return Vocabulary(path)
