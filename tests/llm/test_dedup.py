import numpy as np
import pyarrow as pa
import pytest

from catchment.llm import op01_repeats, op09_chosen_path, op10_line_dedup
from catchment.llm.buffers import text_buffer

from .edge import bag, docs_of, edge_texts, sha, words


def covered(texts: list[bytes], size: int = 200) -> list[np.ndarray]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - size + 1):
            seen[t[p : p + size]] = seen.get(t[p : p + size], 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                hit[p : p + size] = True
        out.append(hit)
    return out


def test_repeats_match_brute_force(spark):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:6000]) for i, t in edge_texts()]
    raw = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, hit in zip(rows, raw, covered(raw), strict=True):
        spans = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        want.append((i, len(t), int(hit.sum()), spans, sha(np.frombuffer(t, np.uint8)[~hit].tobytes())))
    assert bag(op01_repeats.repeat_digest(docs_of(spark, rows))) == sorted(want, key=repr)


@pytest.mark.parametrize("bucket", [4096, 1, 0])
def test_repeats_of_a_passage_in_many_texts(spark, bucket):
    """One gram in all texts, with surroundings of its own in each; with small
    buckets its windows are split into cells and counted by key."""
    rng = np.random.default_rng(9)
    noise = lambda n: "".join(chr(c) for c in rng.integers(97, 101, n))
    passage, tail = noise(230), noise(60)
    rows = [(k, noise(40 + k) + passage + (tail[: k % 7 * 10] if k % 2 else "") + noise(30)) for k in range(80)]
    rows += [(100, rows[3][1]), (101, passage[:190] + noise(100)), (102, noise(150) * 3)]
    raw = [t.encode() for _, t in rows]
    want = []
    for (i, _), t, hit in zip(rows, raw, covered(raw), strict=True):
        spans = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        want.append((i, len(t), int(hit.sum()), spans, sha(np.frombuffer(t, np.uint8)[~hit].tobytes())))
    assert bag(op01_repeats.repeat_digest(docs_of(spark, rows), bucket)) == sorted(want, key=repr)


@pytest.mark.parametrize("members", [10, 5_000, 40_000, 10_000_000])
def test_repeats_in_split_buckets(members):
    """Cells of any width find the same windows."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 101, 700).astype(np.uint8)
    texts = []
    for k in range(30):
        t = base.copy()
        t[rng.integers(0, 700, 2)] = 65 + k % 5
        texts.append(t[rng.integers(0, 200) :].tobytes())
    data, offsets = text_buffer(pa.array([t.decode() for t in texts]))
    row, h, ctx, pos, first, last = op01_repeats.grams(data, offsets, op01_repeats.Roller())
    parts = [
        (int(hh), int(c), False, *cell)
        for i, hh, c, p, a, b in zip(row, h.view(np.int64), ctx.view(np.int64), pos, first, last, strict=True)
        for cell in op01_repeats.cells(texts[i], int(hh), int(p), int(p - b), int(p - a), members)
    ]
    names = ["h", "ctx", "whole", "key", "span", "lo", "hi", "olo", "left", "right"]
    kinds = [pa.int64()] * 2 + [pa.bool_(), pa.int64()] + [pa.int32()] * 4 + [pa.binary()] * 2
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=names)
    found = {(r["h"], r["ctx"], o) for r in op01_repeats.expand(table).to_pylist() for o in range(r["a"], r["b"] + 1)}
    same = {}
    for i, c in zip(row, ctx.view(np.int64), strict=True):
        same.setdefault(int(c), []).append(int(i))
    count: dict[bytes, set] = {}
    at = []
    for i, hh, c, p, a, b in zip(row, h.view(np.int64), ctx.view(np.int64), pos, first, last, strict=True):
        for s in range(a, b + 1):
            w = texts[i][s : s + 200]
            count.setdefault(w, set()).add(int(c))
            at.append((int(hh), int(c), int(p - s), w))
    assert found == {(hh, c, o) for hh, c, o, w in at if len(count[w]) > 1}
    assert found


@pytest.mark.parametrize("ids", ["own", "shared"])
def test_line_dedup_matches_brute_force(spark, ids):
    rows = edge_texts()
    if ids == "shared":  # rows of one id, and of no id, with other texts and other places of a common line
        common = "this very line stands in many documents, at any place"
        rows = rows + [(i, "\n".join([*["x" * 50 + str(k)] * k, common, "end"])) for k, i in enumerate([None, None, 70, 70, 71, 72, 73])]
    rank = lambda i: -1 if i is None else i
    blanks, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda l: l.strip(blanks).translate(lower)
    holders: dict[str, set] = {}
    for i, t in rows:
        for l in (t or "").split("\n"):
            holders.setdefault(key(l), set()).add(rank(i))
    want = []
    for i, t in rows:
        ls = (t or "").split("\n")
        drop = [len(key(l)) >= 40 and len(holders[key(l)]) >= 5 and rank(i) != max(holders[key(l)]) for l in ls]
        want.append((i, len(ls), sum(drop), sha("\n".join(l for l, d in zip(ls, drop, strict=True) if not d))))
    assert sum(w[2] for w in want) > 5
    assert bag(op10_line_dedup.line_digest(docs_of(spark, rows))) == sorted(want, key=repr)
    assert bag(op10_line_dedup.line_digest(docs_of(spark, rows), batches=1)) == sorted(want, key=repr)


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def links_of(rows):
    sets = [shingle_set(t) for _, t in rows]
    near = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    return [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]


def test_near_duplicates_match_brute_force(spark):
    rows = edge_texts()
    links = links_of(rows)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        want.append((doc, min(ids) if ids else None, len(links[i])))
    got = [(d, c, n) for d, c, n, _ in bag(op09_chosen_path.near_duplicate_digest(docs_of(spark)))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_dense_group_of_near_copies(spark):
    """More near copies than a bucket holds, in chunks and blocks."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 100], f"edit{i}", *base[i % 100 + 1 :]])) for i in range(2600)]
    rows += [(9000 + i, f"quite other words number {i} here") for i in range(50)]
    got = op09_chosen_path.near_duplicate_digest(docs_of(spark, rows)).collect()
    assert {r.class_id for r in got if r.doc_id < 9000} == {0}
    sets = [shingle_set(t) for _, t in rows[:2600]]
    for r in [r for r in got if r.doc_id in (0, 57, 1300, 2599)]:
        own = sets[r.doc_id]
        assert r.n_links == sum(5 * len(own & s) >= 4 * len(own | s) for s in sets) - 1
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got if r.doc_id >= 9000)


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    assert op01_repeats.repeat_digest(empty).collect() == []
    assert op09_chosen_path.near_duplicate_digest(empty).collect() == []
    assert op10_line_dedup.line_digest(empty).collect() == []


def test_line_dedup_of_text_ids(spark):
    line = "a line of at least forty characters that is shared by all of them"
    rows = [(f"id-{c}", f"{c}\n{line}\n{c * 3}") for c in "abcdefgh"] + [(None, line)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for batches in (1, 4):
        got = {r.doc_id: r.n_dropped for r in op10_line_dedup.line_digest(df, batches=batches).collect()}
        assert got == {f"id-{c}": int(c != "h") for c in "abcdefgh"} | {None: 1}
    big = spark.createDataFrame([(2**53 + i, line) for i in range(6)], "doc_id long, text string")
    kept = [r.doc_id for r in op10_line_dedup.line_digest(big).collect() if not r.n_dropped]
    assert kept == [2**53 + 5]


def test_kept_row_of_a_tie_is_the_smallest(spark):
    text = "one text of more than five words that two rows share"
    rows = [(1, text, "fr", "s"), (1, text, "de", "z"), (1, text, "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    assert [tuple(r) for r in op09_chosen_path.keep_first(df).collect()] == [(1, text, "de", "b")]


def test_sets_of_a_large_bucket_all_meet(spark, monkeypatch):
    """A bucket that no split makes small still compares every pair of its sets."""
    from catchment.llm import op09_chosen_path as op9

    for name, value in (("BUCKET", 4), ("BLOCK_ROWS", 8), ("MAX_DEPTH", 0)):
        monkeypatch.setattr(op9, name, value)
    rows = [(7, i, bytes((i % 20 * 7 + k) % 251 for k in range(op9.COORDS))) for i in range(40)]
    found = op9.ties(spark.createDataFrame(rows, "node long, sid long, sig binary")).collect()
    assert {frozenset((r.u, r.v)) for r in found} == {frozenset((i, i + 20)) for i in range(20)}
