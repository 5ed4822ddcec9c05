"""WARC archives with a Zstandard dictionary.

Method.  Every page becomes a WARC/1.1 record.  A task opens an archive,
trains a dictionary on the first records it archives, writes it (itself
compressed) in a leading skippable frame, and then compresses every record in
a frame of its own with that dictionary, so single records can be read.
Records with equal payloads of ``MIN_REVISIT`` bytes or more are one response
and revisits that refer to it; a revisit keeps the HTTP header (with the
payload's length) and the payload's digest, not the payload.

Scale.  Equal payloads are found by SHA-256: one row per payload with its
largest page, by partial aggregation, and joined back to the pages.  Pages
are dealt by (payload, hash of id and url), and a payload's row is copied
``SALTS`` times, so a payload that a third of all pages share is spread.
Rows stream through a writer; it holds one archive's sample (``SAMPLE``
bytes) and one record.  Archives are rolled at ``ROLL`` bytes.  Each attempt
of a task writes files of its own name, and the written table of archives
lists those of the attempts that succeeded: a lost executor or a speculative
copy leaves only files that nothing reads.

Defined results: a null html is an empty payload; a null page_id is smaller
than any, a null url has no target header, control characters of a url are
percent-encoded.  Of rows with the largest page_id the one with the largest
url is the response; rows that repeat id, url and payload are dealt together
and all but one revisit it.  Payloads may be very long (one is held at a
time).  Extra columns are not archived; an empty table gives no archive and
an empty result.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import new_path, ship_package, written

MIN_REVISIT = 1_000
#: Copies of a payload's row, by which its pages are dealt.
SALTS = 16
#: Bytes of records a dictionary is trained on, of the dictionary, and of the
#: pieces that records are cut into for it; compression level.
SAMPLE, DICTIONARY, PIECE, LEVEL = 1 << 20, 64 << 10, 4 << 10, 3
#: Compressed bytes after which the next archive starts.
ROLL = 256 << 20
#: Bytes of records handed to Spark at once when reading.
BATCH = 4 << 20

# Magic numbers of the archive format and its record profile.
SKIPPABLE, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CONTROL = re.compile("[\x00-\x20\x7f]")


def page_records(pages: DataFrame) -> DataFrame:
    """(key, page_id, url, payload, response_id, response_url, group): every
    page with the response of its payload group (null group: it has none);
    the payload is null where only a revisit is written.  Rows that may be
    the same response are in one task, in order."""
    page = pages.select(
        "page_id", F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    page = page.withColumn("key", F.unhex(F.sha2("payload", 256)))
    big = page.filter(F.octet_length("payload") >= MIN_REVISIT)
    same = big.groupBy("key", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    groups = same.groupBy("key").agg(F.sum("n").alias("group"), F.max(F.struct("page_id", "url")).alias("response"))
    groups = groups.filter("group > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    dealt = page.withColumn("salt", salt).repartition("key", "salt")
    joined = dealt.join(groups, ["key", "salt"], "left")
    is_response = F.col("page_id").eqNullSafe(F.col("response.page_id")) & F.col("url").eqNullSafe(F.col("response.url"))
    return joined.select(
        "key", F.col("page_id").cast("string").alias("page_id"), "url", F.octet_length("payload").cast("long").alias("size"),
        F.unhex(F.sha1("payload")).alias("sha1"),
        F.when(F.col("group").isNull() | is_response, F.col("payload")).alias("payload"),
        F.col("response.page_id").cast("string").alias("response_id"), F.col("response.url").alias("response_url"), "group",
    ).sortWithinPartitions("key", "page_id", "url")


# --- records ---------------------------------------------------------------


def record_id(key: bytes, page_id: str | None, url: str | None, copy: int = 0) -> str:
    name = f"{key.hex()} {page_id!r} {url!r} {copy}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _value(text: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", text)


def _record(headers: list[tuple[str, str | None]], block: list[bytes]) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers if value is not None),
             f"Content-Length: {sum(map(len, block))}", "", ""]
    return b"".join(["\r\n".join(lines).encode("utf-8", "replace"), *block, b"\r\n\r\n"])


def page_record(row: dict, copy: int, date: str) -> bytes:
    """The record of a row of ``page_records``; ``copy`` counts rows that
    repeat a response before this one."""
    page_id, url, key = row["page_id"], row["url"], row["key"]
    response = row["payload"] is not None and not copy
    quoted = lambda x: None if x is None else urllib.parse.quote(x)
    headers = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", record_id(key, page_id, url, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _value(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(row["sha1"]).decode()),
        ("WARC-Page-ID", quoted(page_id)),
    ]
    if not response:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(key, row["response_id"], row["response_url"])),
            ("WARC-Refers-To-Target-URI", None if row["response_url"] is None else _value(row["response_url"])),
            ("WARC-Refers-To-Date", date),
            ("WARC-Refers-To-Page-ID", quoted(row["response_id"])),
        ]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    return _record(headers, [http, row["payload"]] if response else [http])


def info_record(name: str, date: str) -> bytes:
    fields = b"software: catchment\r\nformat: WARC File Format 1.1\r\n"
    return _record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
         ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], [fields]
    )


# --- archives --------------------------------------------------------------


def trained_dictionary(records: list[bytes]) -> bytes:
    """A dictionary of the records, or none if they are too few for one."""
    pieces = [r[at : at + PIECE] for r in records for at in range(0, len(r), PIECE)]
    size = min(DICTIONARY, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8, f=18, accel=4).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class ArchiveWriter:
    """One archive file: dictionary frame, then a frame per record."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str, date: str) -> None:
        self.path, self.records, self.bytes, self.dictionary = f"{folder}/{name}", 0, 0, 0
        self._out = system.open_output_stream(self.path, compression=None)
        self._held, self._load, self._compressor = [info_record(name, date)], 0, None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self._compressor is not None:
            self._put(self._compressor.compress(record))
            return
        self._held.append(record)
        self._load += len(record)
        if self._load >= SAMPLE:
            self._begin()

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        held, self._held = self._held, []
        sample, load = [], 0
        for record in held[1:]:
            sample.append(record[: SAMPLE - load])
            load += len(sample[-1])
            if load >= SAMPLE:
                break
        trained = trained_dictionary(sample)
        if trained:
            frame = zstandard.ZstdCompressor(level=19).compress(trained)
            self._put(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
            self.dictionary = len(trained)
            known = zstandard.ZstdCompressionDict(trained)
            known.precompute_compress(level=LEVEL)
            self._compressor = zstandard.ZstdCompressor(dict_data=known, write_checksum=True)
        else:
            self._compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        for record in held:
            self._put(self._compressor.compress(record))

    def close(self) -> tuple[str, int, int, int]:
        if self._compressor is None:
            self._begin()
        self._out.close()
        return self.path, self.records, self.bytes, self.dictionary


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


class _WriteArchives:
    """Writes a task's records; returns a row per archive."""

    def __init__(self, folder: str, date: str, roll: int) -> None:
        self.folder, self.date, self.roll = folder, date, roll

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _system(self.folder)
        system.create_dir(folder, recursive=True)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        done, writer, last, copy = [], None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                if row["group"] is not None and row["payload"] is not None:
                    copy = copy + 1 if row["key"] == last else 0
                    last, repeats = row["key"], copy
                else:
                    repeats = 0
                if writer is None:
                    writer = ArchiveWriter(system, folder, f"{attempt}-{len(done):04d}.warc.zst", self.date)
                writer.add(page_record(row, repeats, self.date))
                if writer.bytes >= self.roll:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        columns = list(zip(*done, strict=True)) if done else [[]] * 4
        types = [pa.string()] + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "records", "bytes", "dictionary"]
        )


def write_archives(pages: DataFrame, folder: str, date: str | None = None, roll: int = ROLL) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder``, which all
    executors share; returns the written table (path, records, bytes,
    dictionary) of its archives."""
    ship_package(pages.sparkSession)
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    archives = page_records(pages).mapInArrow(
        _WriteArchives(folder, date, roll), "path string, records long, bytes long, dictionary long"
    )
    return written(archives, "archives")


def archive_records(stream, frames: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of an archive's records, read in order from a
    seekable binary file."""
    head, known = stream.read(8), None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        data = stream.read(struct.unpack("<I", head[4:])[0])
        if data[:4] == ZSTD_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data)
        known = zstandard.ZstdCompressionDict(data)
    else:
        stream.seek(0)
    text = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(stream, read_across_frames=True), 1 << 16)
    while version := text.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {}
        while (line := text.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = text.read(size)
        if len(block) != size or text.read(4) != b"\r\n\r\n":
            raise ValueError(f"cut record {headers.get('WARC-Record-ID')}")
        yield headers, block


def _page_of(headers: dict[str, str], block: bytes) -> tuple:
    """A page's row of its record; a response's payload is checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http).group(1))
    sha1 = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != sha1):
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    plain = lambda name: urllib.parse.unquote(headers[name]) if name in headers else None
    return (plain("WARC-Page-ID"), headers.get("WARC-Target-URI"), size, sha1.hex(), kind,
            plain("WARC-Refers-To-Page-ID"), payload if kind == "response" else None)


class _ReadArchives:
    def __init__(self, payloads: bool) -> None:
        self.payloads = payloads

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        width, rows, load = len(names) - (not self.payloads), [], 0

        def table():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * width
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types[:width], strict=True)], names[:width]
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, local = _system(path)
                with system.open_input_file(local) as stream:
                    for headers, block in archive_records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_page_of(headers, block)[:width])
                        load += 256 + (len(block) if self.payloads else 0)
                        if load > BATCH:
                            yield table()
                            load = 0
        yield table()


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[,
    payload]) of the records of a table of archives (path); a revisit has no
    payload.  Ids are text, as the archive holds them."""
    ship_package(spark)
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = archives.select("path").repartition(max(1, min(archives.count(), tasks)))
    return dealt.mapInArrow(_ReadArchives(payloads), schema + (", payload binary" if payloads else ""))


def warc_digest(pages: DataFrame) -> DataFrame:
    """Archive the pages below the shared folder and read the archives back."""
    spark = pages.sparkSession
    archives = write_archives(pages, new_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, archives, payloads=False).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
