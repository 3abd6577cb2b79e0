"""WARC archives of individually compressed records with an embedded Zstandard dictionary.

Every archive begins with a skippable frame (magic 0x184D2A5D) that holds a
dictionary trained on records of all parts of the archive; each record is a frame of its own
that uses it, so records can be read singly. Records with equal payloads are written
once, by that with the largest page id; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SharedDir, buckets_for
from ._skew import join_unique

MAGIC = 0x184D2A5D
#: Bytes of records an archive holds before compression, but for one larger record; the dictionary's size; bytes it is trained on, in all and of one record.
ARCHIVE = 32 << 20
DICTIONARY = 48 << 10
TRAINED_ON, PIECE = 2 << 20, 64 << 10
_ID = "urn:x-page:"


def _pieces(r: bytes) -> bytes:
    """A record, or of one over PIECE bytes its beginning, middle and end."""
    if len(r) <= PIECE:
        return r
    third, middle = PIECE // 3, len(r) // 2
    return r[:third] + r[middle : middle + third] + r[-third:]


def dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """A dictionary trained on records spread evenly over the archive; too few of them serve as raw content."""
    size = sum(min(len(r), PIECE) for r in records)
    every = max(1, -(-size // TRAINED_ON))
    samples = [_pieces(r) for r in records[every // 2 :: every]]
    try:
        if len(samples) >= 8:
            return zstd.train_dictionary(DICTIONARY, samples, k=1000, d=8)
    except zstd.ZstdError:
        pass  # too little or too uniform content for training
    return zstd.ZstdCompressionDict(b"".join(samples)[:DICTIONARY] or b"WARC/1.1\r\nWARC-Type: response\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 6) -> list[bytes]:
    """The parts of an archive file."""
    words = dictionary(records)
    raw = words.as_bytes()
    press = zstd.ZstdCompressor(level=level, dict_data=words, write_content_size=True)
    return [struct.pack("<II", MAGIC, len(raw)), raw, *[press.compress(r) for r in records]]


def open_archive(f):  # noqa: ANN001, ANN201
    """A stream of an archive's uncompressed records."""
    magic, n = struct.unpack("<II", f.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    words = zstd.ZstdCompressionDict(f.read(n))
    return zstd.ZstdDecompressor(dict_data=words).stream_reader(f, read_across_frames=True)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit's payload is left out."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Bytes: {size}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:  # noqa: ANN001
    """Headers (names in lower case) and payloads of a stream of records."""
    held = b""

    def more(need: int) -> bool:
        nonlocal held
        while len(held) < need:
            part = stream.read(max(1 << 16, need - len(held)))
            if not part:
                return False
            held += part
        return True

    while more(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more(len(held) + 1):
                raise ValueError("a record is cut")
        lines = held[:end].decode().split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        if not more(end + 8 + n):
            raise ValueError("a record is cut")
        yield head, held[end + 4 : end + 4 + n]
        held = held[end + 8 + n :]


def write_archives(pages: DataFrame, out: SharedDir, min_bytes: int = 0) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns the archives: path, n_records.

    Among rows with equal payloads of at least ``min_bytes`` bytes, that with the
    largest page_id is the response (all of that id, if rows repeat) and the others
    revisit it; smaller payloads are all responses. A null html is an empty payload;
    rows with a null page_id are responses to which nothing refers. Other columns
    are ignored. A task that runs again writes archives under other names; only those
    of the returned table count.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes), F.sha1(F.col("html").cast("binary"))))
    tops = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    joined = join_unique(rows, tops, "digest", "n", ["top"])
    slim = joined.select("page_id", "url", F.when(F.col("top").isNull() | (F.col("top") == F.col("page_id")), F.col("html")).alias("html"), "digest", F.octet_length("html").cast("long").alias("size"), "top")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq = [], 0, 0
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()

        def close() -> pa.RecordBatch:
            name = f"pages-{part:05d}-{attempt}-{seq:04d}.warc.zst"
            out.write(name, *archive(held))
            return pa.record_batch({"path": [name], "n_records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for page_id, url, html, sha, n, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha) if sha else hashlib.sha1(payload).digest()).decode()
                revisit = top is not None and top != page_id
                held.append(record("revisit" if revisit else "response", page_id, url, payload, digest, n, top))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield close()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield close()

    return slim.mapInArrow(write, "path string, n_records long")


def read_archives(archives: DataFrame, source: SharedDir) -> DataFrame:
    """Reads archives (path) back: page_id, payload_bytes, payload_digest, record_type, refers_to. Stored payloads are checked against their digests."""

    def number(uri: str | None) -> int | None:
        text = (uri or "").strip("<>").removeprefix(_ID)
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                with source.open(path) as f:
                    for head, payload in read_records(open_archive(f)):
                        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        values = number(head["warc-record-id"]), len(payload) if kind == "response" else int(head["warc-x-payload-bytes"]), digest, kind, number(head.get("warc-refers-to"))
                        for c, v in zip(rows, values, strict=True):
                            rows[c].append(v)
                yield pa.record_batch([pa.array(v, pa.string() if c in ("payload_digest", "record_type") else pa.int64()) for c, v in rows.items()], names=list(rows))

    return archives.select("path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = SharedDir.new(spark, "warc")
    write_archives(pages, out).write.parquet(out.sub("index"))
    index = spark.read.schema("path string, n_records long").parquet(out.sub("index"))
    return read_archives(index.repartition(buckets_for(spark, index)), out)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
d AS (SELECT p.*, t.top FROM p JOIN t USING (h)),
b AS (
  SELECT d.*, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (('0x' || substr(h, 1 + 10 * CAST(floor(i / 8) AS INT), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31 AS INT), 1), '' ORDER BY i)
    FROM range(32) r(i)) AS digest FROM d)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM b
"""
