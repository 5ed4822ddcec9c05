import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from catchment.llm import op03_url_rules, op04_wrappers, op06_rp_forest

from .edge import bag

URLS = [
    None, "", "example.com/en/x", "http://example.com/en/1", "HTTP://WWW.Example.COM/en/1?q#f", "http://blog.example.com/en/",
    "http://example.com", "http://example.com?x=/en/", "http://notexample.com/en/1", "https://a.b.net/es/9", "https://net/fr/",
    "https://x.net/de/", "ftp://x.org/a://b.com/", "http:///path", "http://com/", "http://.com/", "http://a..com/x",
    "http://www.example.com/EN/1", "http://example.com/en/1", "x://y://z.com/", "http://example.com:80/en/", "http://é.com/ü?",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [
        (len(r), r, v) for v, r in op03_url_rules.RULES
        for rh, rp in [(r[: r.index("/")], r[r.index("/") :])]
        if (host == rh or host.endswith("." + rh)) and path.startswith(rp)
    ]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3])] * 2 + [(None, URLS[9])] + [(100 + i, URLS[9]) for i in range(500)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, rule string")
    got = bag(op03_url_rules.judge_urls(pages, op03_url_rules.rules_table(spark)))
    assert got == sorted(((i, *expected(u)) for i, u in rows), key=repr)
    assert op03_url_rules.judge_urls(pages.limit(0), op03_url_rules.rules_table(spark)).collect() == []


def page(body: str, head: str = "<head><title>T</title><script>if (a < b) '</p>'</script></head>") -> str:
    return f"<!DOCTYPE html><html>{head}<body><nav><ul><li><a href=/>Home</a><li>News</ul></nav>{body}<footer>&copy; me</footer>"


BODIES = {
    1: ("<article><h1>Head&nbsp;line</h1><p>First <b>bold\n text<br>more<p>Second &amp; last</article>",
        "Head line\nFirst bold text more\nSecond & last"),
    2: ("<article><h1>Other</h1><p>Only</p><aside>Side</aside><div class='comments'><p>Nice!</p></div></article>", "Other\nOnly"),
    3: ("<div class='cookie-notice'>We use cookies</div><div id=content><h2>Sub</h2><p>Text</p><h2>Sub 2</h2><p>Text 2</p></div>",
        "Sub\nText\nSub 2\nText 2"),
    4: ("<!-- <p>no</p> --><main><ul><li>one<li>two</ul>tail<form><p>Name</p><button>Go</button></form></main>", "one\ntwo\ntail"),
    5: ("<div>" * 300 + "deep" + "</div>" * 300, "deep"),
}


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", page(b)) for i, (b, _) in BODIES.items()]
    rows += [(9, None, None), (10, "http://h1.org/", ""), (1, rows[0][1], rows[0][2]), (11, "x", "just text < 3 &lt;")]
    pages = spark.createDataFrame([(*r, "z", "w") for r in rows], "page_id long, url string, html string, text string, wrapper string")
    got = {r.page_id: r for r in op04_wrappers.extract_text(pages).collect()}
    want = {i: t for i, (_, t) in BODIES.items()} | {9: "", 10: "", 11: "just text < 3 <"}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert op04_wrappers.extract_text(pages).count() == len(rows)
    assert op04_wrappers.extract_text(pages.limit(0)).collect() == []


def test_wrapper_pattern():
    whole = op04_wrappers.Wrapper([])
    for i in range(8):
        own = op04_wrappers.Wrapper.of(page(f"<article><h1>T{i}</h1>{'<p>x%d</p>' % i * (i + 1)}<p>All rights reserved</p></article>"
                                            + ("<div>Share this</div>" if i % 2 else "")))
        whole = own if not whole.items else whole
        whole.add(own)
    whole = op04_wrappers.Wrapper.load(whole.dump()).number()
    pattern = op04_wrappers.pattern(whole.items)
    assert "(<p>#</p>)+" in pattern and "(<div>#</div>)?" in pattern and "(<li>#</li>)+" in pattern
    found = whole.texts(op04_wrappers.parse(page("<article><h1>New</h1><p>a</p></article>")))
    assert op04_wrappers.main_texts(found, frozenset()) == ["New", "a"]


def wrapper_texts(pages):
    """The texts of every page by the wrapper of all, counted in plain Python;
    streams in the order the operator fixes."""
    wrapper = op04_wrappers.Wrapper

    def joined(parts):
        whole = wrapper.load(parts[0])
        for p in parts[1:]:
            whole.add(wrapper.load(p))
        return whole.dump()

    fan, groups = op04_wrappers.FAN, {}
    for dump in sorted({wrapper.of(p).dump() for p in pages}):
        groups.setdefault(xxhash.xxh64_intdigest(dump, seed=42) % fan**2, []).append(dump)
    some = {}
    for part in sorted(groups):
        some.setdefault(part % fan, []).append(joined(groups[part]))
    whole = wrapper.load(joined([joined(some[part]) for part in sorted(some)])).number()
    texts, slots = Counter(), Counter()
    for p in set(pages):
        seen = {(slot, op04_wrappers.text_hash(t)) for keep, slot, t in whole.texts(op04_wrappers.parse(p)) if keep == 1 and slot >= 0}
        texts.update(seen)
        slots.update({slot for slot, _ in seen})
    template = frozenset(k[1] for k, n in texts.items() if n >= 5 and 2 * n >= slots[k[0]])
    return [op04_wrappers.main_texts(whole.texts(op04_wrappers.parse(p)), template) for p in pages]


def plain_site(rng, n):
    """Pages whose tags and names say nothing, with their main texts."""
    menu = [f"Menu {rng.random()}" for _ in range(rng.randint(3, 6))]
    links = "".join(f"<div>{m}</div>" for m in menu)
    out = []
    for i in range(n):
        blocks, texts = [], []
        for k in range(rng.randint(1, 9)):
            tag, text = rng.choice(["p", "p", "p", "h2", "pre"]), f"text {i} {k} {rng.random()}"
            blocks.append(f"<{tag}>{text}</{tag}>")
            texts.append(text)
        extra = "<section><p>Read our offers</p></section>" if rng.random() < 0.6 else ""
        out.append((f"<html><body><div>{links}</div>{extra}<div><div>{''.join(blocks)}</div></div><div><p>All rights reserved</p></div></body></html>", texts))
    return out


def test_wrapper_finds_the_template_whatever_the_order(spark):
    rng = random.Random(3)
    sites = {h: plain_site(rng, n) for h, n in enumerate([40, 25, 15, 6, 3])}
    rows = [(1000 * h + i, f"http://s{h}.org/{i}", p) for h, site in sites.items() for i, (p, _) in enumerate(site)]
    rows += rows[:20]
    want = {}
    for h, site in sites.items():
        for i, texts in enumerate(wrapper_texts([p for p, _ in site])):
            want[1000 * h + i] = "\n".join(texts)
            if h < 3:  # the others are too few to know a template
                assert texts == site[i][1]
    bare = op04_wrappers.Wrapper([]).texts(op04_wrappers.parse(sites[0][0][0]))
    assert op04_wrappers.main_texts(bare, frozenset()) != sites[0][0][1]
    for parts in (1, 4, 16):
        rng.shuffle(rows)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = op04_wrappers.extract_text(pages).collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)


def test_alignment_is_a_longest_common_subsequence_at_any_length():
    rng = random.Random(4)
    for n in [*range(12)] * 20 + [150] * 5:
        x, y = rng.choices("abc", k=n), rng.choices("abcd", k=rng.randint(0, n + 3))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        pairs = op04_wrappers.common(x, y)
        assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    x = rng.choices("abcdef", k=20_000)
    assert len(op04_wrappers.common(x, ["z", *x[:9000], *x[9500:]])) == 19_500


def test_parts_at_any_depth_and_very_long_pages():
    deep = lambda body: "<div>" * 250 + body + "</div>" * 250
    assert wrapper_texts([deep("<nav><ul><li>n</ul></nav><div><p>a</p></div><footer><div>f</div></footer><p>b")]) == [["a", "b"]]
    assert wrapper_texts([deep("<div>s</div><article><h1>a</h1><form>f</form><p>b</p></article><p>s")]) == [["a", "b"]]
    long = [f"<{t}>{t}{i}</{t}>" for i, t in enumerate(random.Random(6).choices(["p", "h2", "pre", "h3", "div", "table"], k=5000))]
    want = [f"{t}{i}" for i, t in enumerate(random.Random(6).choices(["p", "h2", "pre", "h3", "div", "table"], k=5000))]
    assert wrapper_texts([f"<article>{''.join(long)}</article>", f"<article>{''.join(long[1::2])}</article>"]) == [want, want[1::2]]
    assert wrapper_texts(["<center>" * 100_000 + "x"]) == [["x"]]


def test_template_rule_spares_articles_and_counts_different_pages():
    articles = [page(f"<article><h1>Same</h1><p>x{i}</p><h2>References</h2><ul><li>y{i}</ul></article>") for i in range(6)]
    assert wrapper_texts(articles) == [["Same", f"x{i}", "References", f"y{i}"] for i in range(6)]
    assert wrapper_texts(articles[:4]) == wrapper_texts(articles)[:4]
    copied = "<div><p>z</p></div><h3>Only here</h3>"
    pages = [page(f"<div><p>x{i}</p></div><pre>All rights reserved</pre>") for i in range(5)] + [page(copied)] * 5
    assert wrapper_texts(pages) == [[f"x{i}"] for i in range(5)] + [["z", "Only here"]] * 5


def test_texts_of_nested_groups_and_of_nodes_not_found():
    part = "<h2>a</h2><p>b</p><h2>c</h2><p>d</p><ul><li>e</ul><pre>f</pre>"
    assert wrapper_texts([page(f"<article>{part * 2}</article>")]) == [list("abcdef") * 2]
    assert wrapper_texts([page(f"<article>{part * 3}</article>"), page(f"<article>{part}<p>g</article>")]) == [
        list("abcdef") * 3, list("abcdefg")]
    # The second div has no place of its own before the first page's div, which knows no ul.
    apart = [page("<div><p>x</p></div><h1>h</h1><div><ul><li>y<li>z</ul><nav>n</nav></div>"), page("<h1>h</h1><div><ul><li>w</ul></div>")]
    assert wrapper_texts(apart) == [["x", "h", "y", "z"], ["h", "w"]]
    whole = op04_wrappers.Wrapper.of(page("<article><p>known</p></article>")).number()
    found = whole.texts(op04_wrappers.parse(page("<article><div><h2>new</h2><form>f</form></div></article>")))
    assert op04_wrappers.main_texts(found, frozenset()) == ["new"]


def test_names_of_parts_count_whole_and_not_around_the_article():
    def texts(body, tag="<body>"):
        return wrapper_texts([f"<html class='search'>{tag}{body}</body></html>"])[0]

    article = "<article class='post related'><p>a</p></article>"
    assert texts(article, "<body class='sidebar has-sidebar comments-open'>") == ["a"]
    assert texts("<main id=search><p>a</p></main>") == ["a"]
    assert texts("<div class='content no-sidebar'><p>a</p><div class='sidebar wide'>s</div><div id='comment-12'>c</div></div>") == ["a"]
    assert texts(f"<div class='overlay'><nav>n</nav>{article}<div class=promo>s</div></div><p>b</p>") == ["a"]
    assert texts("<div class='widget'><section role=main><p>a</p></section></div>") == ["a"]
    assert texts(f"{article}<div class='comments'><article><p>c</p></article></div>") == ["a"]
    assert texts("<div><p>a</p></div><div class='comments'><article><p>c</p></article></div>") == ["a"]
    assert texts("<div class='widget'><aside><article>c</article></aside></div><p>a</p>") == ["a"]
    assert texts("<div class='main-menu'>m</div><p>a</p><div class='main-content'><p>b</p></div>") == ["b"]


def test_nearest_with_edges(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[300]  # a third of all rows is one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (None, rows[0][1]),
             (2004, [*rows[0][1][:-1], None]), (2005, [float("inf")] * 16), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, id int")
    got = op06_rp_forest.nearest(df, F.col("id") % 100 == 0, "vec_id", "embedding").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 100)) and all(len(v) == 10 for v in by.values())
    y, hit = x.astype(np.float64), 0
    for q, found in by.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        hit += len({v for v, _ in found} & set(want))
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
        assert all(abs(d[v] - s) < 1e-12 for v, s in found)
    assert [v for v, _ in by[300]] == list(range(301, 311))
    assert hit >= 0.9 * 90
    few = op06_rp_forest.nearest(df.filter("vec_id < 4"), F.col("id") == 0, "vec_id", "embedding").collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert op06_rp_forest.nearest(df.limit(0), F.col("id") == 0, "vec_id", "embedding").collect() == []
