"""Small tables with every awkward row, and brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PASSAGE = "the rain in spain stays mainly on the plain said nobody who had ever been there in the month of may"


def edge_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, other = prose(150), prose(120)
    line = "This is a line that many documents share, all of them equally."
    near = base.split()
    near[70] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "   \n\n  "), (4, "!!! ... ---"), (5, "one"), (6, "One two THREE"), (7, base), (8, base),
        (9, " ".join(near)), (10, base + "\n" + other), (11, "x" * 3000), (12, "ab" * 1500), (13, prose(20_000)),
        (14, "ÀÉÎ ñandú straße 日本語のテキスト é 👩‍👩‍👧 \x1c\x85\u00a0 end"), (15, "It's <|endoftext|> we'll <|STARTOFTEXT|>"),
        (16, f"before {PASSAGE.upper()} after " + prose(30)), (17, prose(40) + " " + " ".join(PASSAGE.split()[3:14])),
        (18, " ".join(PASSAGE.split()[:9])), (20, base), (20, base), (None, "a document without id " + prose(30)),
        (None, None), (21, "a\x00b\x00" * 200), (22, other[:200]), (23, other[:199]), (24, "\n".join([line, prose(5), line])),
    ]
    rows += [(30 + i, "\n".join([prose(4), line if i % 2 else f"\t{line.upper()} ", prose(6)])) for i in range(6)]
    rows += [(40 + i, f"{prose(25)} {other[:260]} {prose(25)}") for i in range(4)]
    return rows


def docs_of(spark, rows=None):
    """documents with more columns, named as operators might name their own."""
    data = [(i, t, "en" if k % 3 else None, f"s{k % 2}", len(t or ""), "x", 1, "y")
            for k, (i, t) in enumerate(edge_texts() if rows is None else rows)]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, host string, pos int, key string"
    )


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def bag(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)
