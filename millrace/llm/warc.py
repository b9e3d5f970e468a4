"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

An archive is a file of Zstandard frames. The first is a skippable frame (magic 0x184D2A5D) that holds the dictionary;
each record follows as one frame. Spark's text writer puts down the frames as raw bytes, so archives go to any file
system that Spark knows and commit like any Spark table; the line separator that it needs is an empty skippable frame,
which Zstandard readers pass over.

Defined cases: a null payload is an empty one. Null ids sort last and get no id header. Rows that repeat an id and its
payload are written each time, with one type. Null or odd URLs are left out or percent-encoded. An empty table gives an
archive folder without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import maybe_broadcast, new_path, written

DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame, all ASCII: magic 0x184D2A50 and length 0.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their bytes are its content."""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def load_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and HTTP body of each record of one archive."""
    if not archive:
        return
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    dictionary = load_dictionary(archive[8 : 8 + size])
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(memoryview(archive)[8 + size :], read_across_frames=True), 1 << 18)
    while version := reader.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("the archive is damaged")
        head = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = reader.read(int(head["Content-Length"]))
        if reader.read(4) != b"\r\n\r\n":
            raise ValueError("the record's length is wrong")
        yield head, block.partition(b"\r\n\r\n")[2]


def choose_revisits(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, int]:
    """Rows (page_id, sha, refers_to) of the pages that repeat an earlier page's payload, and their number.

    Only ids and digests are shuffled; the count of a payload is combined before the shuffle, and the join back is an
    equi-join whose hot keys AQE splits.
    """
    ids = pages.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes)
    groups = ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    found = written(ids.join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct(), "revisits")
    return found, found.count()


def write_archives(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, level: int = 3, dict_bytes: int = 65_536, sample_records: int = 1_000, sample_bytes: int = 2_048, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as archives under path, one for each input partition.

    The dictionary is trained on archived records, headers and all, their payloads cut to a stretch of `sample_bytes`: those
    of the `sample_records` pages whose hashes are least, spread over the whole table. A threshold on the hash comes first,
    so that about twice as many rows and no more are looked at however large the table is, and pages that repeat in every
    column count once. The dictionary changes sizes only, never content.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    revisits, n = choose_revisits(pages, min_revisit_bytes)
    same = (F.col("p.page_id").eqNullSafe(F.col("r.page_id"))) & (F.col("p.sha") == F.col("r.sha"))
    todo = pages.withColumn("sha", F.sha1("payload")).alias("p").join(maybe_broadcast(revisits.alias("r"), n), same, "left").select("p.page_id", "p.url", "p.payload", "r.refers_to", F.col("r.sha").isNotNull().alias("revisit"))

    order = F.xxhash64("page_id", "url", F.octet_length("payload"))
    wide = 2.0**62 * min(1.0, 2 * sample_records / max(pages.count(), 1))
    at = F.pmod(order, F.greatest(F.lit(1), F.octet_length("payload") - sample_bytes)).cast("int") + 1
    few = todo.where(F.abs(order / 2) <= wide).withColumn("o", order).withColumn("payload", F.substring("payload", at, F.lit(sample_bytes)))
    rows = few.groupBy("o").agg(F.first(F.struct("page_id", "url", "payload", "refers_to", "revisit")).alias("r")).orderBy("o").limit(sample_records).select("r.*").collect()
    raw = train_dictionary([build_record(r.page_id, r.url, bytes(r.payload), r.refers_to, r.revisit, date) for r in rows] or [b"WARC/1.1\r\n"], dict_bytes)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = load_dictionary(raw)
        if dictionary:
            dictionary.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
        begun = False
        for b in batches:
            out = [] if begun or not b.num_rows else [struct.pack("<II", DICT_MAGIC, len(raw)) + raw]
            begun = begun or b.num_rows > 0
            cols = [b.column(i).to_pylist() for i in range(5)]
            out += [packer.compress(build_record(i, u, p, to, again, date)) for i, u, p, to, again in zip(*cols, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    todo.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """All records under path; each response's payload is checked against its digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for archive in b.column(0):
                out: list[tuple] = []
                held = 0
                for head, body in read_records(archive.as_py()):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and base32_sha1(body) != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                    number = lambda k, h=head: int(h[k]) if k in h else None
                    out.append((number("X-Page-Id"), number("X-Payload-Length"), digest, head["WARC-Type"], number("X-Refers-To-Page-Id"), head.get("WARC-Target-URI"), body if payloads and head["WARC-Type"] == "response" else None))
                    held += len(body) if payloads else 0
                    if len(out) >= 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, FIELDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, min_revisit_bytes=0)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT DISTINCT t, sha1(t) AS x FROM p),
digests AS (
  SELECT t, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    16 * (strpos('0123456789abcdef', substr(x, 5 * i // 4 + 1, 1)) - 1) + strpos('0123456789abcdef', substr(x, 5 * i // 4 + 2, 1)) - 1
    ) // (CASE 5 * i % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)) % 32)::INT, 1), '' ORDER BY i) AS d
  FROM h, range(32) AS r(i) GROUP BY t),
firsts AS (SELECT t, min(page_id) AS least FROM p GROUP BY t)
SELECT p.page_id, strlen(p.t) AS payload_bytes, d.d AS payload_digest,
  CASE WHEN p.page_id = f.least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> f.least THEN f.least END AS refers_to
FROM p JOIN digests d ON d.t = p.t JOIN firsts f ON f.t = p.t
"""
