import hashlib
import io
import random
import struct

import pytest
import zstandard

from catchment.llm import op11_warc as W, stage

from .edge import bag


def made():
    rng = random.Random(9)
    words = ["<p>", "</p>", "<div class='x'>", "maison", "forêt", "日本語", "river", "\r\n", "WARC/1.1", "\n\n"]
    page = lambda n: " ".join(rng.choices(words, k=n))
    big, other, short = page(400), page(500), "x" * 999
    rows = [(i, f"http://h{i % 5}.org/{i}", page(rng.choice([3, 50, 300]))) for i in range(60)]
    rows += [(100 + i, f"http://copy.org/{i}", big) for i in range(40)]
    rows += [(200, None, None), (201, "http://a.org/", ""), (202, "http://b.org/", short), (203, "http://c.org/", short)]
    rows += [(300, "http://t.org/1", other), (300, "http://t.org/2", other), (300, "http://t.org/2", other), (299, "u", other)]
    rows += [(None, "http://n.org/", other), (None, None, "y" * 1000), (None, "a b\r\nX: 1", "y" * 1000), (400, "z", "ab" * 600_000)]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, group int")


def brute(rows):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        known = sorted(i for i in ids if i is not None)
        ids = [None] * (len(ids) - len(known)) + known
        for k, i in enumerate(ids):
            response = len(data) < 1000 or k == len(ids) - 1
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit",
                        None if response else ids[-1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_round_trip(spark, parts):
    rows = made()
    got = W.warc_digest(frame_of(spark, rows).repartition(parts))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert bag(got) == brute(rows)


def test_archives(spark):
    rows = made()
    folder = stage.new_path(spark, "warc-test")
    archives = W.write_archives(frame_of(spark, rows), folder, roll=20_000)
    listed = archives.collect()
    assert sum(a.records for a in listed) == len(rows) and any(a.dictionary for a in listed) and len(listed) > 1
    payloads = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    for r in W.read_archives(spark, archives).collect():
        assert r.payload == (payloads[r.payload_digest] if r.record_type == "response" else None)
    for a in listed:
        _, path = W._system(a.path)
        data = open(path, "rb").read()
        records = list(W.archive_records(io.BytesIO(data)))
        assert records[0][0]["WARC-Type"] == "warcinfo" and len(records) == a.records + 1
        at, known, frames = 0, None, 0  # every record is a frame that can be read alone
        if a.dictionary:
            magic, size = struct.unpack("<II", data[:8])
            assert magic == 0x184D2A5D
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
            at = 8 + size
        while at < len(data):
            frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
            assert frame.decompress(data[at:]).startswith(b"WARC/1.1\r\n")
            at, frames = len(data) - len(frame.unused_data), frames + 1
        assert frames == len(records)


def test_ids_of_responses(spark):
    ids, refers = set(), set()
    archives = W.write_archives(frame_of(spark, made()), stage.new_path(spark, "warc-ids")).collect()
    for a in archives:
        for headers, _ in W.archive_records(open(W._system(a.path)[1], "rb")):
            assert headers["WARC-Record-ID"] not in ids or headers["WARC-Type"] == "warcinfo"
            if headers["WARC-Type"] == "response":
                ids.add(headers["WARC-Record-ID"])
            refers.add(headers.get("WARC-Refers-To"))
    assert refers - {None} <= ids


def test_dictionary_helps():
    records = [W.page_record({"page_id": str(i), "url": f"http://a.org/{i}", "key": bytes([i]), "sha1": bytes(20), "size": 5,
                              "payload": b"<html>%d</html>" % i, "response_id": None, "response_url": None}, 0, "2020")
               for i in range(200)]
    known = zstandard.ZstdCompressionDict(W.trained_dictionary(records))
    size = lambda c: sum(len(c.compress(r)) for r in records)
    assert size(zstandard.ZstdCompressor(dict_data=known)) < 0.6 * size(zstandard.ZstdCompressor())


def test_empty_and_damaged(spark):
    assert W.warc_digest(frame_of(spark, [])).collect() == []
    headers = {"WARC-Payload-Digest": "sha1:" + "A" * 32, "WARC-Type": "response", "WARC-Record-ID": "x"}
    with pytest.raises(ValueError):
        W._page_of(headers, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")


def test_text_ids(spark):
    rows = [("a %\n", "u", "q" * 1200), ("b", "u", "q" * 1200), (None, "u", "small")]
    got = W.warc_digest(spark.createDataFrame(rows, "page_id string, url string, html string"))
    assert sorted((r.page_id or "", r.record_type, r.refers_to) for r in got.collect()) == [
        ("", "response", None), ("a %\n", "revisit", "b"), ("b", "response", None)]
