import corpus_pipeline as P
from catchment.llm import queries, tokens

from .edge import PASSAGE, bag, docs_of, edge_texts, words
from .test_dedup import links_of


def test_stages_on_edges(spark, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, docs, seen = str(tmp_path), docs_of(spark), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    rows = edge_texts()
    lettered = sorted((i, t) for i, t in rows if t and any(c.isalpha() for c in t) and i is not None)
    kept = [(r.doc_id, r.text) for r in seen["language_id"].collect()]
    assert sorted(r for r in kept if r[0] is not None) == lettered
    lines = [(r.doc_id, r.text) for r in seen["line_dedup"].collect()]
    assert len(lines) == len(kept) and sum(t.count("many documents share") for _, t in lines) == 1
    links = links_of(lines)
    stay = [(r.doc_id, r.text) for r in seen["near_duplicates"].collect()]
    alone = [row for row, l in zip(lines, links, strict=True) if not l]
    assert set(alone) <= set(stay) <= set(lines) and len(stay) < len(lines)
    assert not any(links_of(stay)[k] for k in range(len(stay)))
    clean = {r.doc_id for r in seen["decontamination"].collect()}
    assert clean == {i for i, _ in stay} - {16, 17}
    lib = Tokenizer.from_file(tokens.default_path())
    texts = {r.doc_id: r.text for r in seen["decontamination"].collect()}
    for r in seen["bpe_encoding"].collect():
        assert r.token_ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert len(words(PASSAGE)) > 10


def test_stages_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in P.STAGES:
        assert stage(spark, docs_of(spark, []), str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_bag_keeps_repeats(spark):
    assert len(bag(docs_of(spark, [(1, "a"), (1, "a")]))) == 2
