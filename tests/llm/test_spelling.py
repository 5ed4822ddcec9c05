import random
import re
import zlib
from collections import Counter

import pytest

from catchment.llm import op13_spelling as S

from .edge import docs_of, edge_texts


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def brute_variants(counts):
    letters = sorted(set("".join(counts)))
    near = {w: sorted((v for v in edits(w, letters) if v in counts), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: v[0] if v and counts[v[0]] >= 10 * counts[w] else None for w, v in near.items()}
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def made_words(seed):
    """Words of few letters with mutations, so trie classes are crowded."""
    rng = random.Random(seed)
    words = {"".join(rng.choices(alphabet, k=rng.randint(7, 10))) for alphabet in ("ea", "etb", "éàxyz", "abcdefgh")
             for _ in range(120)}
    for word in sorted(words):
        i, c = rng.randrange(len(word)), rng.choice("eatéb")
        words |= {word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]}
    long = "ab" * 40
    words |= {long, long + "a", long[:50] + "x" + long[50:], long[:-1] + "c", "x" * 3000, "x" * 3001, "eeeeeeea", "aeeeeeee"}
    return {w: rng.choice([2, 3, 25, 300, 4000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("limit", [5, S.LIMIT])
def test_variants_equal_brute_force(spark, limit):
    counts = made_words(7)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = sorted((tuple(r) for r in S.spelling_variants(df, limit).collect()), key=repr)
    want = brute_variants(counts)
    assert got == want
    assert sum(r[4] for r in got) > len(got) and any(r[2] != r[0] and r[2] != r[1] for r in got)


def test_digest_on_edges(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 1 << 12)
    rng = random.Random(3)
    common = ["commune", "réunion", "straße", "Banking", "ÀÉÎÕabcé", "thinking"]
    rows = edge_texts() + [(100 + i, " ".join(rng.choices(common, k=400))) for i in range(20)]
    rows += [(200, "y" * 9000 + " " + "y" * 9000), (201, "naïveté×÷naïveté ŒUVREŒUVRE œuvreœuvre"), (200, "y" * 9000)]
    got = sorted((tuple(r) for r in S.spelling_digest(docs_of(spark, rows)).collect()), key=repr)
    assert got == brute_variants(brute_counts(rows))
    assert any(r[1] for r in got)


def test_occurrences_do_not_depend_on_flushes(spark, monkeypatch):
    rows = edge_texts()
    counter = S.WordCounter()
    for doc_id, text in rows:
        if text is not None:
            counter.add("" if doc_id is None else str(doc_id), text)
            counter.settle()
    got = {w.decode("latin-1"): n for w, n in counter.taken().items() if n >= 2}
    assert got == brute_counts(rows)


def test_empty_table(spark):
    assert S.spelling_digest(docs_of(spark).limit(0)).collect() == []
    assert S.spelling_digest(docs_of(spark, [(1, None), (2, "")])).columns == [
        "word", "form", "root", "n", "n_near", "form_n"]


def test_one_edit():
    assert S.one_edit(b"abc", b"abcd") and S.one_edit(b"abcd", b"abd") and S.one_edit(b"abc", b"axc")
    assert not S.one_edit(b"abc", b"abc") and not S.one_edit(b"abcd", b"abdc") and not S.one_edit(b"abc", b"abcde")
