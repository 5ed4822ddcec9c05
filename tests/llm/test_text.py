import zlib

import numpy as np
from pyspark.sql import functions as F

from catchment.llm import op02_decontaminate, op05_bpe_trie, op07_token_counts, op08_lang_cnn, tokens

from .edge import PASSAGE, bag, docs_of, edge_texts, sha, words


def bench_of(spark, rows):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "item_id long, text string, doc_id string")


ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "One two three!"), (3, None), (4, "..."), (5, "never seen words at all"), (11, "one")]


def test_decontamination_matches_brute_force(spark):
    want = []
    for i, t in edge_texts():
        w = words(t)
        hit, items = set(), set()
        for item, text in ITEMS:
            x = words(text)
            size = min(10, len(x))
            for s in range(len(x) - size + 1 if x else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[s : s + size]:
                        hit |= set(range(p, p + size))
                        items.add(str(item))
        want.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    got = bag(op02_decontaminate.decontamination_digest(docs_of(spark), bench_of(spark, ITEMS)))
    assert got == sorted(want, key=repr)
    assert sum(w[5] for w in want) >= 4


def test_decontamination_blocks_and_empty(spark, monkeypatch):
    docs = docs_of(spark)
    whole = bag(op02_decontaminate.decontamination_digest(docs, bench_of(spark, ITEMS)))
    monkeypatch.setattr(op02_decontaminate, "BLOCK_WORDS", 8)
    assert bag(op02_decontaminate.decontamination_digest(docs, bench_of(spark, ITEMS))) == whole
    none = op02_decontaminate.decontamination_digest(docs, bench_of(spark, [])).collect()
    assert len(none) == docs.count() and not any(r.contaminated for r in none)
    assert op02_decontaminate.decontamination_digest(docs_of(spark, []), bench_of(spark, ITEMS)).collect() == []


def test_spans_and_proximity(spark):
    docs, bench = docs_of(spark), bench_of(spark, [(1, PASSAGE)])
    out = {r.doc_id: r for r in op02_decontaminate.decontaminate(docs, bench).collect()}
    assert [tuple(s) for s in out[16]["__dc_spans"]] == [(1, 1 + len(PASSAGE.split()))]
    assert out[16]["host"] == "x"
    near = op02_decontaminate.proximity_matches(docs, bench, min_places=3).collect()
    assert "16" in {r["__dc_id"] for r in near}


def test_proximity_of_items_with_an_absent_word(spark):
    item = "aa bb cc dd ee ff gg hh ii jj"
    docs = docs_of(spark, [(1, f"x y {item.replace('ee', 'changed')} z"), (2, "aa x " * 20 + "bb"), (3, item.replace("ee", "new word"))])
    for text in (item, f"{item} kk", f"{item} kk ll"):  # kk and ll occur nowhere either
        near = op02_decontaminate.proximity_matches(docs, bench_of(spark, [(1, text)]), min_places=9).collect()
        assert {r["__dc_id"] for r in near} == {"1", "3"}
    absent = bench_of(spark, [(1, "never seen words at all")])
    assert op02_decontaminate.proximity_matches(docs, absent, min_places=1).collect() == []


def test_encoder_and_counter_match_the_library(spark):
    from tokenizers import Tokenizer

    lib, rows, want, counts = Tokenizer.from_file(tokens.default_path()), edge_texts(), [], []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False))))
        counts.append((i, len((t or "").encode()), len(ids), len(ids) > 2048))
    assert bag(op05_bpe_trie.bpe_digest(docs_of(spark))) == sorted(want, key=repr)
    assert bag(op07_token_counts.count_tokens(docs_of(spark))) == sorted(counts, key=repr)
    encoded = op05_bpe_trie.encode_texts(docs_of(spark)).filter("doc_id = 6").first()
    assert encoded["token_ids"] == lib.encode("One two THREE", add_special_tokens=False).ids
    # a worker that forgets its chunks all the time, and hashes the decoded texts
    hashed = op05_bpe_trie.encode_texts(docs_of(spark), hashed=True, max_bytes=2_000)
    assert hashed.columns == [c for c in docs_of(spark).columns if c != "text"] + ["token_ids", "decoded_sha256"]
    got = [(r.doc_id, len(r.token_ids), sha(np.array(r.token_ids, "<u4").tobytes()), r.decoded_sha256) for r in hashed.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for f in (op05_bpe_trie.bpe_digest, op07_token_counts.count_tokens):
        assert f(docs_of(spark, [])).collect() == []


def test_language_id(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    got = {r.doc_id: r for r in op08_lang_cnn.predict_languages(docs).collect()}
    fold = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in fold) and sum(r.held_out for r in got.values()) == len(fold)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in fold]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_training_windows_are_of_the_whole_text(spark):
    marks = "".join(f"{i:07d} " for i in range(20_000))  # 160,000 bytes that tell their place
    texts = [(i, f"{marks}{i}", "en") for i in range(20)] + [(30, "é", "fr"), (31, "Aé" * 200, "fr"), (32, "é", "fr")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    sample = op08_lang_cnn.training_sample(docs)
    assert sample == op08_lang_cnn.training_sample(docs.repartition(3))
    parts = [w for lang, some in sample if lang == "en" for w in some]
    assert all(any(w in t.encode() for _, t, _ in texts) for w in parts)
    assert {len(some) for _, some in sample} == {op08_lang_cnn.SAMPLE_WINDOWS}
    assert all(8 <= len(w) <= 256 for w in parts) and sum(len(w) == 256 for w in parts) * 2 == len(parts)
    places = [marks.encode().find(w) for w in parts]
    assert min(places) < 40_000 and max(places) > 120_000
    assert op08_lang_cnn.train_network(sample).langs == ["en", "fr"]


def test_texts_of_several_known_languages_stay(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "text", "lang")
    by = {r.lang: r.t for r in docs.filter("length(text) > 3000").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    assert len(by) >= 4
    parts = [t.encode()[:2560].decode(errors="ignore").encode().ljust(2560) for t in by.values()]
    mixed = spark.createDataFrame([(-1, b"".join(parts).decode(), None), (-2, "12 34", None)], docs.schema)
    kept = {r.doc_id for r in op08_lang_cnn.known_language(docs.union(mixed)).filter("doc_id < 0").collect()}
    assert kept == {-1}


def test_language_id_edges(spark):
    docs = docs_of(spark)
    got = op08_lang_cnn.predict_languages(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by[i].lang_pred for i in (1, 2, 3, 4)} == {"und"} and by[1].score == 0
    assert by[7].lang_pred == "en" and by[7].score == 1  # the only language
    none = op08_lang_cnn.predict_languages(docs_of(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert op08_lang_cnn.predict_languages(docs_of(spark, [])).collect() == []


def test_folded_tables_equal_the_plain_forward_pass():
    net = op08_lang_cnn.ByteCNN(["a", "b", "c"])
    rng = np.random.default_rng(8)
    x = rng.integers(0, 256, (20, op08_lang_cnn.WINDOW), dtype=np.uint8)
    net.train(x, np.arange(20) % 3)
    pooled = []
    for w in op08_lang_cnn.WIDTHS:
        kernel = net.p[f"w{w}"].astype(np.float64).reshape(w, op08_lang_cnn.EMBED, -1)
        places = [sum(net.p["emb"][x[:, at + i]].astype(np.float64) @ kernel[i] for i in range(w))
                  for at in range(x.shape[1] - w + 1)]
        pooled.append(np.maximum(np.max(places, 0) + net.p[f"b{w}"], 0))
    want = np.concatenate(pooled, 1) @ net.p["out"] + net.p["bias"]
    assert np.allclose(op08_lang_cnn.Predictor(net).logits(x), want, rtol=1e-3, atol=1e-3)


def test_training_sample_does_not_depend_on_ids(spark):
    rows = [(i, f"text number {i} " * 40, "en" if i % 2 else "fr") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = docs.filter(~op08_lang_cnn.held_out(F.col("doc_id")))
    texts = [(r.text, r.lang) for r in kept.collect()]
    ids = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    other = spark.createDataFrame([(i, *t) for i, t in zip(ids, reversed(texts), strict=True)], docs.schema)
    assert op08_lang_cnn.training_sample(docs) == op08_lang_cnn.training_sample(other)
