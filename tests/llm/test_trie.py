import hashlib
import random
import zlib

import pytest

from catchment.llm import listrank, op12_prefix_trie as P, scan

COLUMNS = "conv_id long, turn long, role string, text string, pos int, depth int, k1 string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], COLUMNS)


def made(seed=5):
    rng = random.Random(seed)
    rows, texts = [], ["", None, "hello", "héllo 日本", "hello there", "yes", "no", "x" * 70 + "a", "x" * 70 + "b"]
    for c in [*range(0, 60), *range(95, 140), *range(203, 215), -7, -205, 10**12]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", "assistant", None]),
                         rng.choice(texts if rng.random() < 0.5 else texts[2:4])))
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(400)]  # one very long conversation
    rows += [(400 + k, t, "user", "the same") for k in range(90) for t in range(2)]  # one very common one
    rows += [rows[3], rows[3], (500, 0, "user", "z" * 200_000)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100 * (1 if c >= 0 else -1))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if full[c] == node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("base", [20, P.BASE])
def test_trie_equals_brute_force(spark, base):
    rows = made()
    got = P.trie_digest(table_of(spark, rows), base)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_texts_of_nodes(spark):
    rows = [(100, 0, "user", "a"), (100, 1, None, "b"), (101, 0, "user", "a")]
    df = table_of(spark, rows)
    turns = P.turn_rows(df)
    trie = P.with_turns(P.prefix_trie(turns, turns.select("conv_id").distinct()), df)
    got = sorted((r.depth, r.n_convs, r.role, r.text) for r in trie.collect())
    assert got == [(0, 2, None, None), (1, 2, "user", "a"), (2, 1, "", "b")]


def test_empty_tables(spark):
    assert P.trie_digest(table_of(spark, [])).collect() == []
    assert P.trie_digest(table_of(spark, [(None, 1, "user", "x")])).collect() == []


def test_scan_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 9]), rng.randint(0, 5), rng.randint(-2**62, 2**62)) for _ in range(700)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(5)
    got = scan.sorted_scan(df, ["g"], ["o", "v"], ["g", "o", "v"], ["v"], ["v"], ["v"]).collect()
    want, rows = [], sorted(rows)
    for i, (g, o, v) in enumerate(rows):
        same = i > 0 and rows[i - 1][0] == g
        pos, total, first = (want[-1][3] + 1, want[-1][4] + v, want[-1][5]) if same else (0, v, v)
        after = rows[i + 1] if i + 1 < len(rows) else (None, None, None)
        want.append((g, o, v, pos, scan._wrap(total), first, after[2], after[0] == g))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_list_ranks(spark):
    order = list(range(3000))
    random.Random(4).shuffle(order)
    links = [(a, n, 1) for a, n in zip(order, [*order[1:], None])]
    df = spark.createDataFrame(links, "a long, n long, w long")
    got = {r.a: r["rank"] for r in listrank.list_ranks(df, base=30).collect()}
    assert got == {a: len(order) - i for i, a in enumerate(order)}
