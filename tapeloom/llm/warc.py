"""WARC archives of individually compressed records that share a Zstandard dictionary.

Layout of an archive file: a leading skippable frame (magic 0x184D2A5D) holds
the dictionary; after it every WARC record is one Zstandard frame, compressed
with that dictionary; here and there stands an empty skippable frame, which decoders
pass over.  Any record can be read alone from its offset.

Files are written by Spark's own text writer: about a megabyte of frames is one row, and
the empty skippable frame is the line separator.  The writer begins a new file after a number
of rows, so no archive outgrows the task that reads it.  Archives go through Spark's
commit protocol to any file system it can reach, and a lost executor only means
that its tasks run again.

Deduplication: of records with equal payloads of at least ``min_dedup_bytes``
bytes the one with the smallest id is a ``response``; the others are
``revisit`` records without the payload that name it.  Payloads are compared by
SHA-256 and length.

Nulls: a null payload is empty; a null id is written without a row key and is a
response if its payload has no row with an id.  Rows that repeat the smallest id are
all responses.  Only the key, the URL and the payload are read, so further columns may have any name.  A null URL becomes ``urn:row``.  An empty table writes no
archive and reads back no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.util import shared_dir, slices

DICT_MAGIC = 0x184D2A5D
SKIP_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame as text: what Spark puts after every row.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("latin-1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Dictionary training: at most so many records, chosen by hash, so many bytes of each, and the dictionary's size.
TRAIN_RECORDS, TRAIN_BYTES, DICT_BYTES = 1000, 8192, 65_536
#: A row of frames ends at so many bytes, an archive after so many rows.
ROW_BYTES, ARCHIVE_ROWS = 1 << 20, 128

FIELDS = "row_key bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the HTTP header, with the payload's length, and drops the payload."""
    digest = payload_digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "urn:row")
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{k}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(key if key is not None else digest + uri)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if key is not None:
        lines.append(f"X-Row-Key: {key}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Row-Key: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers in lower case, HTTP header, payload); the block digest is verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("WARC record is cut short")
    if headers["warc-block-digest"] != "sha1:" + payload_digest(block):
        raise ValueError("WARC block digest does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != "sha1:" + payload_digest(payload):
        raise ValueError("WARC payload digest does not match")
    return headers, http, payload


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary; too few samples to train give their raw content, none give an empty one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(data)) + data


def frame_length(buf: memoryview, at: int) -> int:
    """Length of the Zstandard or skippable frame at ``at``, from its block headers."""
    magic, n = struct.unpack_from("<II", buf, at)
    if magic in SKIP_MAGICS:
        return 8 + n
    if magic != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    end = at + zstandard.frame_header_size(bytes(buf[at : at + 18]))
    last = False
    while not last:
        b = int.from_bytes(buf[end : end + 3], "little")
        last, kind, size = b & 1, b >> 1 & 3, b >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * (buf[at + 4] >> 2 & 1) - at


def read_archive(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every record of an archive."""
    buf, at, dctx = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(buf):
        n = frame_length(buf, at)
        magic = struct.unpack_from("<I", buf, at)[0]
        if magic == DICT_MAGIC and at == 0:
            d = _dictionary(bytes(buf[8:n]))
            dctx = zstandard.ZstdDecompressor(dict_data=d) if d else dctx
        elif magic == FRAME_MAGIC:
            yield at, n, dctx.decompress(buf[at : at + n])
        at += n


def mark_revisits(df: DataFrame, key: str, payload: str, min_dedup_bytes: int = 0) -> DataFrame:
    """(_key, _url.., _payload, _refers): ``_refers`` is the response's id on revisits, else null."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.withColumns({"_payload": raw, "_key": F.col(key).cast("long")}).withColumn("_sha", F.unhex(F.sha2("_payload", 256)))
    # One small row per distinct payload; the minimum is taken before the shuffle too.
    first = rows.groupBy("_sha").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # A hot payload makes one large join key; adaptive execution can split this join.
    out = rows.join(first, "_sha", "left")
    again = (F.octet_length("_payload") >= min_dedup_bytes) & (F.col("_first") != F.coalesce(F.col("_key"), F.col("_first") - 1))
    return out.withColumn("_refers", F.when(again, F.col("_first")))


def write_archives(
    df: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_dedup_bytes: int = 0,
    date: str = "2020-01-01T00:00:00Z",
    level: int = 3,
    row_bytes: int = ROW_BYTES,
    archive_rows: int = ARCHIVE_ROWS,
) -> None:
    """Write the deduplicated rows to ``path``, each partition as archives of at most ``archive_rows`` rows of frames.

    A row ends with the frame that takes it to ``row_bytes``, so an archive is bounded by the two and the longest frame;
    the writer begins a new file after so many rows, and the first row of each file carries the dictionary.
    """
    spark, df = df.sparkSession, df.select(key, url, payload)
    clean = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    # First the keys, then only their payloads: tasks send the driver a few small rows each
    drawn = df.select(F.xxhash64(F.lit("train"), key).alias("_h"), F.col(key).alias("_drawn")).orderBy("_h", "_drawn").limit(TRAIN_RECORDS)
    rows = df.join(F.broadcast(drawn.select("_drawn").distinct()), F.col(key).eqNullSafe(F.col("_drawn")), "left_semi")  # at most TRAIN_RECORDS keys
    sample = rows.select(F.col(key).cast("long").alias("_k"), F.col(url).alias("_u"), F.substring(clean, 1, TRAIN_BYTES).alias("_p")).orderBy(F.xxhash64("_k"), "_k", "_u", "_p").limit(TRAIN_RECORDS).collect()
    sample.sort(key=lambda r: (r["_k"] is not None, r["_k"] or 0, bytes(r["_p"])))
    data = train_dictionary([make_record(r["_k"], r["_u"], bytes(r["_p"]), None, date) for r in sample])
    shared = spark.sparkContext.broadcast(data)  # at most DICT_BYTES

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dictionary(shared.value)
        cctx = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
        frames, held, done = [], 0, 0

        def row() -> pa.RecordBatch:
            lead = dictionary_frame(shared.value) if done % archive_rows == 0 else b""
            return pa.RecordBatch.from_arrays([pa.array([lead + b"".join(frames)], pa.binary())], names=["frame"])

        for batch in batches:
            for part in slices(batch, "_payload", 4 << 20):
                cols = [part.column(c).to_pylist() for c in ("_key", "_url", "_payload", "_refers")]
                for k, u, p, r in zip(*cols):
                    frames.append(cctx.compress(make_record(k, u, p, r, date)))
                    held += len(frames[-1])
                    if held >= row_bytes:
                        yield row()
                        frames, held, done = [], 0, done + 1
        if frames:
            yield row()

    rows = mark_revisits(df, key, payload, min_dedup_bytes).select("_key", F.col(url).cast("string").alias("_url"), "_payload", "_refers")
    frames = rows.mapInArrow(compress, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", archive_rows).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives under ``path``: ``FIELDS``, file, offset, length and the payload if asked for."""
    schema = FIELDS + ", file string, offset bigint, length bigint" + (", payload binary" if with_payload else "")

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                name = batch.column("path")[i].as_py()
                for at, n, record in read_archive(batch.column("content")[i].as_py()):
                    h, http, body = parse_record(record)
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    num = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                    row = (num("x-row-key"), h["warc-target-uri"], length, h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], num("x-refers-to-row-key"), name, at, n)
                    rows.append((*row, body) if with_payload else row)
                    held += len(body) if with_payload else 100
                    if held > 4 << 20:
                        yield _batch(rows, with_payload)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(unpack, schema)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * with_payload
    names = ["row_key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive_round_trip(df: DataFrame, **options) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    path = f"{shared_dir(df.sparkSession)}/tapeloom/warc-{uuid.uuid4().hex}"
    write_archives(df, path, **options)
    return read_archives(df.sparkSession, path)
